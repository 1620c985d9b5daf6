"""Kinds of characters, tokens of texts, and their readings, as Column expressions and plans.

Patterns hold only what both Java's and RE2's regular expressions know.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolex.functions import sound_tables as S
from echolex.functions.columns import let, offsets

# White space, and the marks that end a span whatever their Unicode category.
SPACE = " 　\t\n\r"
MARKS = "、。，．,.!?！？「」『』（）()［］[]｛｝{}〈〉《》・…‥:：;；\"'“”‘’/／\\|｜~〜"

# Parts of speech and affixes at which no span begins or ends.
BLOCKED_POS = ["助詞", "助動詞", "接尾辞", "補助記号", "記号", "空白", "接続詞", "感動詞", "副詞", "連体詞"]
AFFIXES = (
    "さん サン 様 さま 君 くん ちゃん 氏 殿 どの 先生 の は が を に へ と で も や か ね よ な から まで より など とか ので のに けど けれど "
    "です ます した する して され せる れる られ だ た て い る ら り ば ず ぬ ん っ そう よう たち ども がた 側 的 性 化 式 系"
).split()
COMMON_POS = ["動詞", "形容詞", "形状詞", "副詞", "連体詞", "接続詞", "感動詞"]
NOUN, COMMON_NOUNS, PROPER_NOUNS = "名詞", ["普通名詞", "数詞"], ["固有名詞"]

# Sounds that a compound's later part may voice.
PLAIN, VOICED = "カキクケコサシスセソタチツテトハヒフヘホ", "ガギグゲゴザジズゼゾダヂヅデドバビブベボ"


def _escaped(characters: str) -> str:
    return "".join(f"\\x{{{ord(c):X}}}" for c in characters)


def _digits() -> str:
    """Decimal digits, and the other characters that stand for one digit (superscripts, circled ones and so on)."""
    odd = [c for c in range(0x80, 0x20000) if chr(c).isdigit() and unicodedata.category(chr(c)) != "Nd"]
    starts = [c for c in odd if c - 1 not in odd]
    ends = [c for c in odd if c + 1 not in odd]
    return r"\p{Nd}" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True))


#: Insides of character classes; each character is of the first kind that has it.
CLASSES = {
    "latin": r"A-Za-z\x{130}\x{212A}\x{FF21}-\x{FF3A}\x{FF3C}\x{FF3E}-\x{FF5A}",
    "space": _escaped(SPACE),
    "mark": _escaped(MARKS),
    "hiragana": r"\x{3041}-\x{3096}\x{309D}\x{309E}",
    "katakana": r"\x{30A1}-\x{30FA}\x{30FC}-\x{30FE}",
    "kanji": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3005}\x{3006}",
    "digit": _digits(),
    "punct": r"\p{P}",
}


def kind(character: Column | str) -> Column:
    """space, punct, hiragana, katakana, kanji, digit, latin or other, of a single character."""
    c = F.col(character) if isinstance(character, str) else character
    out = F
    for name, inside in CLASSES.items():
        out = out.when(c.rlike(f"^[{inside}]$"), "punct" if name == "mark" else name)
    return out.otherwise("other")


#: A token: a run of Latin letters or of digits, or any other single character.
TOKEN = rf"[{CLASSES['latin']}]+|[{CLASSES['digit']}]+|[\x{{0}}-\x{{10FFFF}}]"
#: A unit of word error rates: a run of one kind, or one mark; white space is none.
UNIT = "|".join([*(f"[{CLASSES[k]}]+" for k in ("hiragana", "katakana", "kanji", "digit", "latin")), f"[{CLASSES['mark']}{CLASSES['punct']}]", f"[^{''.join(CLASSES.values())}]+"])


def units(text: Column | str) -> Column:
    """The units of a text that word error rates count, in order."""
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def _spoken(surface: Column, names: dict[str, str], first: str) -> Column:
    """The names of a run's characters, joined; those without one are silent. Names are looked up by place."""
    listed = F.array(*map(F.lit, names.values()))
    at = lambda c: F.ascii(c) - ord(first)
    return F.array_join(F.transform(F.split(F.lower(surface), ""), lambda c: F.when((at(c) >= 0) & (at(c) < len(names)), F.get(listed, at(c))).otherwise("")), "")


def tokens(docs: DataFrame, kanji: DataFrame) -> DataFrame:
    """doc_id, tok, surface, start, end, kind, readings, pos, pos2, blocked, common, proper of each token of each text.

    ``kanji`` (kanji, readings: best first) is the table of readings. Kana read as themselves, Latin letters and digits by
    their spoken names; what has no reading has none. Without parts of speech no token is common or proper. Repeated
    doc_ids are not told apart; null and empty texts have no tokens. Places are summed up within a text's row."""
    # kinds are made inside the array, once a token, before the rows are
    each = F.transform(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), lambda s: F.struct(s.alias("surface"), kind(F.substring(s, 1, 1)).alias("kind")))
    found = docs.select("doc_id", each.alias("t")).select("doc_id", "t", offsets(F.transform("t", lambda t: F.length(t["surface"]))).alias("start"))
    found = found.select("doc_id", F.posexplode(F.arrays_zip("t", "start")).alias("tok", "x")).select("doc_id", "tok", "x.t.surface", "x.t.kind", "x.start")
    found = found.withColumn("end", F.col("start") + F.length("surface"))
    table = kanji.select(F.col("kanji").alias("_k"), F.col("readings").alias("_r"))
    # no more rows than there are kanji: a bounded broadcast, where a join by surface brings each blank to one task
    found = found.join(F.broadcast(table.where(F.rlike("_k", F.lit(f"^[{CLASSES['kanji']}]$")))), (F.col("kind") == "kanji") & (F.col("surface") == F.col("_k")), "left")
    one = F.when(F.col("kind").isin("hiragana", "katakana"), F.col("surface"))
    one = one.when(F.col("kind") == "digit", _spoken(F.col("surface"), S.DIGIT_NAMES, "0")).when(F.col("kind") == "latin", _spoken(F.col("surface"), S.LETTER_NAMES, "a"))
    readings = F.coalesce(F.when(F.col("kind") == "kanji", F.col("_r")).when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))
    none = F.lit("")
    found = found.select("doc_id", "tok", "surface", "start", "end", "kind", readings.alias("readings"), none.alias("pos"), none.alias("pos2"))
    return with_flags(found)


def with_flags(tokens: DataFrame) -> DataFrame:
    """Tokens (surface, kind, pos, pos2) of any reader with blocked, common and proper."""
    pos, pos2 = F.coalesce("pos", F.lit("")), F.coalesce("pos2", F.lit(""))
    blocked = F.col("kind").isin("punct", "space") | pos.isin(BLOCKED_POS) | F.col("surface").isin(AFFIXES)
    noun = pos == NOUN
    return tokens.withColumns({"blocked": blocked, "common": pos.isin(COMMON_POS) | (noun & pos2.isin(COMMON_NOUNS)), "proper": noun & pos2.isin(PROPER_NOUNS)})


def lexicon_tokens(docs: DataFrame, lexicon: DataFrame, kanji: DataFrame, longest: int = 8) -> DataFrame:
    """Tokens as ``tokens`` gives them, with parts of speech from a lexicon (surface, readings, pos, pos2).

    At each place the longest word of the lexicon that begins there and overlaps no word taken before is a token (left to right);
    characters that no word covers are tokens of their own kind. Words are found by an equi-join of a text's runs of up to
    ``longest`` characters."""
    plain = tokens(docs, kanji)
    ahead = Window.partitionBy("doc_id").orderBy("tok").rowsBetween(0, longest - 1)
    runs = plain.select("doc_id", "tok", "start", F.collect_list("surface").over(ahead).alias("run"))
    runs = runs.select("doc_id", "tok", "start", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("run")), lambda n: F.array_join(F.slice("run", F.lit(1), n), ""))).alias("n", "word"))
    words = lexicon.select(F.col("surface").alias("word"), F.col("readings").alias("w_readings"), F.col("pos").alias("w_pos"), F.col("pos2").alias("w_pos2")).dropDuplicates(["word"])
    best = runs.join(words, "word").groupBy("doc_id", "tok").agg(F.max_by(F.struct("n", "word", "w_readings", "w_pos", "w_pos2"), "n").alias("w"))
    rows = plain.join(best, ["doc_id", "tok"], "left")
    each = F.struct("tok", "surface", "start", "end", "kind", "readings", F.col("w.n").alias("n"), F.col("w.word").alias("word"), F.col("w.w_readings").alias("w_readings"), F.col("w.w_pos").alias("w_pos"), F.col("w.w_pos2").alias("w_pos2"))
    # a text's places in order: a place is taken unless a word before it still covers it
    ordered = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(each)).alias("all"))
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("at"))
    step = lambda s, t: F.when(t["tok"] < s["next"], s).otherwise(F.struct((t["tok"] + F.coalesce(t["n"], F.lit(0)) + 1).alias("next"), F.concat(s["at"], F.array(t["tok"])).alias("at")))
    taken = ordered.select("doc_id", "all", F.aggregate("all", start, step)["at"].alias("at"))
    taken = taken.select("doc_id", F.posexplode(F.transform("at", lambda i: F.get("all", i))).alias("tok", "t"))
    known = F.col("t.word").isNotNull()
    taken = taken.select(
        "doc_id", "tok", F.coalesce("t.word", "t.surface").alias("surface"), F.col("t.start").alias("start"), F.when(known, F.col("t.start") + F.length("t.word")).otherwise(F.col("t.end")).alias("end"),
        "t.kind", F.when(known, F.col("t.w_readings")).otherwise(F.col("t.readings")).alias("readings"), F.coalesce("t.w_pos", F.lit("")).alias("pos"), F.coalesce("t.w_pos2", F.lit("")).alias("pos2"),
    )
    return with_flags(taken)


def reading_of_texts(tokens: DataFrame) -> DataFrame:
    """doc_id, reading: first readings joined; marks, white space and what has no reading stay as they are."""
    own = F.when(F.col("kind").isin("punct", "space") | (F.size("readings") == 0), F.col("surface")).otherwise(F.get("readings", F.lit(0)))
    parts = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("tok", own.alias("r")))).alias("r"))
    return parts.select("doc_id", F.array_join(F.col("r.r"), "").alias("reading"))


def voiced(reading: Column) -> Column:
    """The reading as the later part of a compound, its first sound voiced; null where it has no voiced form."""
    head = F.substring(reading, 1, 1)
    return F.when(head.isin(list(PLAIN)), F.concat(F.translate(head, PLAIN, VOICED), F.substring(reading, F.lit(2), F.length(reading))))


def with_voiced(variants: Column, run: Column, most: int) -> Column:
    """``variants`` of a run of tokens, then each with a later token's first reading voiced where it first stands."""
    later = F.filter(run, lambda t, i: (i > 0) & (F.size(t["readings"]) > 0) & voiced(F.get(t["readings"], F.lit(0))).isNotNull())

    def replaced(v: Column, base: Column) -> Column:
        at = F.instr(v, base)
        return F.when(at > 0, F.concat(F.substring(v, F.lit(1), at - 1), voiced(base), F.substring(v, at + F.length(base), F.length(v))))

    def both(plain: Column) -> Column:
        more = F.flatten(F.transform(later, lambda t: F.transform(plain, lambda v: replaced(v, F.get(t["readings"], F.lit(0))))))
        return F.slice(F.array_distinct(F.concat(plain, F.filter(more, lambda v: v.isNotNull()))), 1, 2 * most)

    return let(variants, both)
