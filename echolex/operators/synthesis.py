"""Made-up glossaries and sentences from tables of parts, and labels of what went wrong in a transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolex.operators import hallucination

# What may go wrong in a transcript (labels and their names); with what it is like.
PATHOLOGIES = [
    ("term-phonetic", "固有名詞の音韻的置換", "a listed name comes out as another word of the same or a close sound"),
    ("voicing", "濁音・清音の取り違え", "a consonant inside a name gains or loses its voice"),
    ("long-vowel", "長音の脱落・付加", "a vowel is held too long, or cut short"),
    ("geminate", "促音の脱落・付加", "a doubled consonant is heard as single, or a single one as doubled"),
    ("moraic-nasal", "撥音の脱落", "the syllabic n is not heard"),
    ("particle-drop", "助詞の欠落", "a weak particle is missing"),
    ("word-drop", "語の脱落", "a few words are missing"),
    ("number-unit", "数字・単位の誤り", "another number or unit stands there"),
    ("hallucination", "定型の幻聴", "a stock phrase that nobody said, where there was silence or noise"),
]
# Acoustic conditions (speed, signal to noise in dB, room, band, name).
CONDITIONS = [
    (1.00, None, "close", "wide", "clean"),
    (1.15, 20.0, "close", "wide", "fast-clean"),
    (0.90, 15.0, "close", "wide", "slow-noisy"),
    (1.00, 10.0, "far", "wide", "far-field"),
    (1.05, 5.0, "reverb", "wide", "reverb-noisy"),
    (1.00, 12.0, "far", "telephone", "telephone"),
]
SILENCES, NOISES, NOISE_LEVELS = (1.5, 3.0, 6.0), (2.0, 5.0), (-5.0, 0.0)


def pathologies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PATHOLOGIES, "label string, ja string, how string")


def conditions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONDITIONS, "speed double, snr_db double, room string, band string, label string")


def silence_probes(spark: SparkSession) -> DataFrame:
    """Audio without speech, of which any transcript is made up: kind, seconds, snr_db, gold (empty)."""
    rows = [("silence", s, None, "") for s in SILENCES] + [("noise", s, level, "") for s in NOISES for level in NOISE_LEVELS]
    return spark.createDataFrame(rows, "kind string, seconds double, snr_db double, gold string")


def draw(*parts: Column | str) -> Column:
    """A number from 0 to 1 that depends on the parts alone (52 bits of md5, as SQL elsewhere can compute it too)."""
    text = F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def glossary(parts: DataFrame, n: int, seed: str, exclude: DataFrame | None = None) -> DataFrame:
    """``n`` entries (entry_id, surface, reading, category, weight) in a seeded order, made of a first and a second part each.

    ``parts``: category, slot (1 or 2), surface, reading, share (of the category among entries), weight. Each category gives its
    share of the entries as far as its combinations go; ``exclude`` (surface, reading) shares neither with the result. Too few
    combinations are an error. Combinations are made per category by an equi-join of its two parts."""
    a = parts.where("slot = 1").select("category", "share", "weight", F.col("surface").alias("s1"), F.col("reading").alias("r1"))
    b = parts.where("slot = 2").select("category", F.col("surface").alias("s2"), F.col("reading").alias("r2"))
    made = a.join(b, "category").select("category", "share", "weight", F.concat("s1", "s2").alias("surface"), F.concat("r1", "r2").alias("reading"))
    made = made.groupBy("surface").agg(F.min(F.struct("category", "share", "weight", "reading")).alias("m")).select("surface", "m.*")
    if exclude is not None:
        for c in ("surface", "reading"):
            made = made.join(exclude.select(c).distinct(), c, "left_anti")
    # an entry's turn: drawn evenly within its category, sooner for larger shares
    turn = -F.log(F.greatest(draw(F.lit(seed), "category", "surface"), F.lit(1e-18))) / F.col("share")
    chosen = made.withColumn("turn", turn).orderBy("turn", "surface").limit(n)
    have = chosen.count()
    if have < n:
        raise ValueError(f"only {have} of {n} entries: more parts are needed")
    return chosen.withColumn("entry_id", F.xxhash64("surface")).select("entry_id", "surface", "reading", "category", "weight", "turn")


def disjoint(parts: DataFrame, n_train: int, n_test: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """Two glossaries that share neither a surface nor a reading."""
    train = glossary(parts, n_train, seed)
    return train, glossary(parts, n_test, seed + "|test", exclude=train)


def sentences(terms: DataFrame, templates: list[str], n: int, seed: str) -> DataFrame:
    """id, text, terms: ``n`` sentences from templates with {T0}, {T1} (terms: place from 0 without gaps, surface) and {N}, {N2} (numbers)."""
    count = terms.count()
    rows = terms.sparkSession.range(n).select(F.col("id"))
    pick = lambda what, most: F.floor(draw(F.lit(seed), F.lit(what), "id") * most).cast("long")
    rows = rows.select("id", F.get(F.array(*map(F.lit, templates)), pick("template", len(templates)).cast("int")).alias("t"), *(pick(f"T{i}", count).alias(f"p{i}") for i in (0, 1)), (pick("N2", 28) + 1).alias("n2"), (pick("N", 98) + 2).alias("n"))
    for i in (0, 1):
        rows = rows.join(terms.select(F.col("place").alias(f"p{i}"), F.col("surface").alias(f"t{i}")), f"p{i}")
    text = F.col("t")
    for mark, value in (("{T0}", "t0"), ("{T1}", "t1"), ("{N2}", "n2"), ("{N}", "n")):
        text = F.replace(text, F.lit(mark), F.col(value).cast("string"))
    return rows.select("id", text.alias("text"), F.array_distinct(F.array("t0", "t1")).alias("terms"))


def labels(gold: Column, heard: Column, terms: Column) -> Column:
    """What went wrong between a text and its transcript, sorted: a missing term, much missing text, other digits, a phrase
    that was not said; a missing term too where texts differ and nothing else is known."""
    digits = lambda t: F.regexp_extract_all(t, F.lit("[0-9０-９]"), F.lit(0))
    phrases = F.array(*map(F.lit, hallucination.PHRASES))
    missing = F.exists(terms, lambda t: (t != "") & ~heard.contains(t))
    made_up = F.exists(phrases, lambda p: heard.contains(p) & ~gold.contains(p))
    found = F.array_compact(
        F.array(F.when(missing, "term-phonetic"), F.when(F.length(heard) < F.length(gold) * 0.85, "word-drop"), F.when(digits(gold) != digits(heard), "number-unit"), F.when(made_up, "hallucination"))
    )
    return F.when((F.size(found) == 0) & (gold != heard), F.array(F.lit("term-phonetic"))).otherwise(F.array_sort(found))
