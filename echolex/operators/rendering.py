"""Edits for people to look at: a text with what goes and what comes marked, and the evidence for a proposal, as HTML.

All text is escaped; the marks are <del>, <ins> and <mark>, so that any style sheet may dress them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What stands for characters that HTML gives a meaning to; the ampersand comes first.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
NOTHING = "ε"


def escape(text: Column) -> Column:
    for character, name in ESCAPES:
        text = F.replace(text, F.lit(character), F.lit(name))
    return text


def _marked(tag: str, text: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), escape(text), F.lit(f"</{tag}>"))


def diff(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id, html, shown: each text (doc_id, text) with its edits (doc_id, start, end, replacement; null: only removed) marked, and how many are.

    Edits are taken by start, then end; one that begins before the end of one taken is left out. Line ends become <br>. Null texts are
    empty; texts without edits are escaped alone."""
    own = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("_edits"))
    none = F.array().cast(own.schema["_edits"].dataType)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).join(own, "doc_id", "left").withColumn("_edits", F.coalesce("_edits", none))
    text = F.col("_text")
    cut = lambda a, b: F.substring(text, a + 1, b - a)
    first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("shown"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        new = F.coalesce(_marked("ins", e["replacement"]), F.lit(""))
        piece = F.concat(escape(cut(s["at"], e["start"])), _marked("del", cut(e["start"], e["end"])), new)
        return F.when(e["start"] < s["at"], s).otherwise(F.struct(e["end"].alias("at"), (s["shown"] + 1).alias("shown"), F.concat(s["out"], F.array(piece)).alias("out")))

    last = lambda s: F.struct(F.concat(F.array_join(s["out"], ""), escape(cut(s["at"], F.length(text)))).alias("html"), s["shown"].alias("shown"))
    done = rows.select("doc_id", F.aggregate("_edits", first, step, last).alias("r"))
    return done.select("doc_id", F.replace("r.html", F.lit("\n"), F.lit("<br>")).alias("html"), F.col("r.shown").cast("long").alias("shown"))


def evidence(rows: DataFrame, most_rejected: int = 12) -> DataFrame:
    """``rows`` of ``correction.explain`` with ``html``: the phonemes of both, distance and bound, the gate's probability, and the
    alignment. Of each text's rejected proposals the first ``most_rejected`` by place are shown; all accepted ones are."""
    place = F.row_number().over(Window.partitionBy("doc_id", "accepted").orderBy("start", "end"))
    shown = rows.withColumn("_place", place).where(F.col("accepted") | (F.col("_place") <= most_rejected)).drop("_place")
    either = lambda c: F.when(c == "", F.lit(NOTHING)).otherwise(c)
    chain = F.array_join(F.transform("alignment", lambda o: F.concat(F.format_string('<span title="%.2f">', o["cost"]), escape(F.concat(o["op"], either(o["a"]))), F.lit("&rarr;"), escape(either(o["b"])), F.lit("</span>"))), " ")
    state = F.when(F.col("applied"), "applied").otherwise("not applied")
    line = lambda name, value: F.concat(F.lit(f"<dt>{name}</dt><dd>"), value, F.lit("</dd>"))
    html = F.concat(
        F.lit('<dl class="evidence"><dt>'), state, F.lit("</dt><dd>"), _marked("del", F.col("span")), F.lit(" "), _marked("ins", F.col("replacement")), F.lit("</dd>"),
        line("heard", escape(F.array_join("phonemes", " "))), line("term", escape(F.array_join("t_phonemes", " "))),
        line("distance", F.format_string("%.4f &le; %.2f (%.3f)", "nd", "tau", "raw")), line("gate", F.concat(F.format_string("%.4f, margin %.3f, ", "probability", "margin"), escape(F.col("reason")))),
        line("alignment", chain), F.lit("</dl>"),
    )
    return shown.withColumn("html", html)
