"""Queries over tokens, indexes, gates, measures, prompts and made-up data, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolex import catalog
from echolex.functions import characters, sounds
from echolex.functions import sound_tables as S
from echolex.functions.columns import once
from echolex.operators import correction, glossary, hallucination, lookup, measures, prompts, synthesis
from echolex.operators import gate as gates
from echolex.sources import glossaries, pairs

_read = catalog._read
NO_KANJI = "kanji string, readings array<string>"
TERM = "[a-z]{6,}"
TEMPLATES = ["{T0} from {T1}.", "{T0} in {N} pieces, ask {T1}.", "{T1} of {N2}/{N}: {T0}.", "{T0} and {T1}."]
OUTCOMES = ["repair", "damage", "neutral", "no-op", "repair", "no-op", "no-op"]
GATE = gates.Gate(weights=tuple((i - 9) / 10 for i in range(20)), bias=0.3, platt=(0.8, -0.1), mean=tuple(i / 10 for i in range(20)), scale=tuple(1 + i / 5 for i in range(20)))


def _no_kanji(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], NO_KANJI)


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = characters.tokens(_read(spark, sf_dir, "documents"), _no_kanji(spark))
    reading = F.coalesce(F.get("readings", F.lit(0)), F.lit(""))
    return rows.select("doc_id", "tok", "surface", "start", F.col("end").alias("stop"), "kind", reading.alias("reading"))


def char_kind_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = _read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\x{0}-\x{10FFFF}]"), F.lit(0))).alias("c"))
    return letters.groupBy("c").agg(F.count("*").alias("n")).groupBy(characters.kind("c").alias("kind")).agg(F.sum("n").cast("long").alias("n"))


def wer_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").select("doc_id", characters.units(F.coalesce("text", F.lit(""))).alias("u"))
    return rows.select("doc_id", F.size("u").cast("long").alias("units"), F.md5(F.array_join("u", "|")).alias("digest"))


def _heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts as they might be misheard, and as they might then be corrected."""
    text = F.coalesce("text", F.lit(""))
    wrong = F.replace(F.replace(text, F.lit("the"), F.lit("ze")), F.lit("on"), F.lit("o n"))
    return _read(spark, sf_dir, "benchmark").select("item_id", text.alias("reference"), wrong.alias("baseline"), F.replace(F.replace(wrong, F.lit("o n"), F.lit("on")), F.lit("er"), F.lit("ar")).alias("corrected"))


_HEARD = """heard AS (SELECT item_id, text AS reference, baseline, replace(replace(baseline, 'o n', 'on'), 'er', 'ar') AS corrected
  FROM (SELECT item_id, coalesce(text, '') AS text, replace(replace(coalesce(text, ''), 'the', 'ze'), 'on', 'o n') AS baseline FROM benchmark))"""


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("term")).distinct()
    return found.select("term", F.substring("term", 1, 1).alias("category"))


_TERMS = f"terms AS (SELECT term, term[1] AS category FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '{TERM}')) AS term FROM benchmark))"


def corpus_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _heard(spark, sf_dir).select((F.col("item_id") % 4).alias("part"), "reference", F.col("baseline").alias("hypothesis"))
    return measures.corpus_wer(rows, "part").withColumn("wer", F.round("wer", 9))


def term_recall_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _heard(spark, sf_dir).withColumnRenamed("baseline", "hypothesis")
    return measures.term_recall(rows, _terms(spark, sf_dir), ["category"]).withColumn("recall", F.round("recall", 9))


def term_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.term_damage(_heard(spark, sf_dir), _terms(spark, sf_dir)).withColumn("damage_rate", F.round("damage_rate", 9))


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measures.summarize(_heard(spark, sf_dir), _terms(spark, sf_dir))
    return rows.select("n", *(F.round(c, 9).alias(c) for c in rows.columns if c != "n"))


def hallucination_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up phrases after part names, every fifth of which was really said, and every seventh left in."""
    docs = catalog._transcripts(spark, sf_dir).join(_read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_name"), "doc_id")
    said = F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(F.col("p_name"))
    rows = docs.select(said.alias("reference"), F.col("text").alias("baseline"), F.when(F.col("doc_id") % 7 == 0, F.col("text")).otherwise(F.col("p_name")).alias("corrected"))
    rates = measures.removal_rate(rows, hallucination.PHRASES)
    return rates.select("hallucinations", "removed", "legitimate", "false_removals", F.round("removal_rate", 9).alias("removal_rate"), F.round("false_removal_rate", 9).alias("false_removal_rate"))


def _word_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    words = catalog.words(spark, sf_dir)
    entries = words.select(F.crc32("word").alias("entry_id"), F.col("word").alias("surface"), F.length("word").cast("double").alias("weight"), F.array(catalog.as_kana("word")).alias("readings"))
    return entries, lookup.readings(entries)


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookup.index_stats(*_word_index(spark, sf_dir))
    return rows.withColumn("mean_posting", F.round("mean_posting", 9))


def _asked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _read(spark, sf_dir, "part").select("p_name").distinct()
    return once(names, phonemes=sounds.phonemes(catalog.as_kana("p_name"))).select(F.col("p_name").alias("q_key"), "phonemes", F.lit(0.28).alias("tau"))


def screen_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.screen(_asked_names(spark, sf_dir), _word_index(spark, sf_dir)[1]).select(F.col("q_key").alias("name"))


def topk_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words' nearest words by shared grams: each its own first."""
    _, index = _word_index(spark, sf_dir)
    asked = catalog.words(spark, sf_dir).select(F.col("word").alias("q_key"), "phonemes")
    found = lookup.top_k(asked, index, lookup.QueryBounds(), exhaustive=False)
    return found.select(F.col("q_key").alias("word"), "rank", "surface", F.round("raw", 6).alias("raw"), F.round("nd", 6).alias("nd"))


def retrieval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = catalog.words(spark, sf_dir).select(F.col("word").alias("q_key"), "phonemes")
    return lookup.retrieval_recall(asked, _word_index(spark, sf_dir)[1]).withColumn("recall", F.round("recall", 6))


def logistic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = {n: (F.col("p_partkey") % (i + 2)) / 7.0 for i, n in enumerate(gates.FEATURES) if n != "span_is_glossary_surface"}
    features["span_is_glossary_surface"] = (F.col("p_size") % 11 == 0).cast("double")
    return _read(spark, sf_dir, "part").select("p_partkey", F.round(GATE.probability(features), 9).alias("probability"))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.get(F.array(*map(F.lit, OUTCOMES)), ((F.col("p_partkey") + F.col("p_size")) % 7).cast("int"))
    return _read(spark, sf_dir, "part").select(((F.col("p_partkey") * 37 + F.col("p_size") * 11) % 1009 / 1009).alias("probability"), outcome.alias("outcome"))


def gate_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gates.sweep(_outcomes(spark, sf_dir))
    return rows.select("threshold", *(F.col(c).cast("long").alias(c) for c in ("accepted", "repairs", "damages", "neutrals")), *(F.round(c, 9).alias(c) for c in ("correction_rate", "damage_rate", "edit_damage_rate")))


def pick_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.pick_threshold(gates.sweep(_outcomes(spark, sf_dir)), 0.1)


def prompt_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part names that fit a prompt, in order of their first key."""
    names = catalog.names_glossary(spark, sf_dir).select("entry_id", "surface", F.col("surface").alias("reading"))
    packed = prompts.pack(names, 100)
    return names.where(F.col("entry_id").isin(packed.places)).select("entry_id", "surface", F.lit(packed.used).cast("long").alias("used"), F.lit(packed.entries).cast("long").alias("entries"))


def candidate_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part").groupBy("p_type").agg(F.array_sort(F.collect_set("p_brand")).alias("c"))
    return rows.select("p_type", prompts.candidate_pattern(F.col("c")).alias("pattern"), prompts.choose(F.col("c")).alias("first"))


def missing_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = catalog.words(spark, sf_dir)
    none, empty = F.array().cast("array<string>"), F.lit("")
    entries = words.select(F.crc32("word").alias("entry_id"), F.col("word").alias("surface"), empty.alias("reading"), none.alias("aliases"), empty.alias("category"), F.lit(1.0).alias("weight"), empty.alias("notes"))
    return glossaries.fill_missing_readings(entries, _no_kanji(spark)).select("surface", "reading", F.size("aliases").alias("aliases"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of part names and brands as parts of made-up terms."""
    p = _read(spark, sf_dir, "part")
    names = p.select(F.split("p_name", " ").alias("w")).where("size(w) = 2")
    one = lambda df, category, slot, c, share, weight: df.select(F.lit(category).alias("category"), F.lit(slot).alias("slot"), c.alias("surface"), F.upper(c).alias("reading"), F.lit(share).alias("share"), F.lit(weight).alias("weight")).distinct()
    first, second = F.get("w", F.lit(0)), F.get("w", F.lit(1))
    found = one(names, "product", 1, first, 0.6, 1.0).union(one(names, "product", 2, second, 0.6, 1.0))
    return found.union(one(names, "org", 1, second, 0.4, 0.9)).union(one(p, "org", 2, F.lower("p_type"), 0.4, 0.9))


def synthetic_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.glossary(_parts(spark, sf_dir), 60, "seed").select("surface", "reading", "category", "weight")


def disjoint_glossaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = synthesis.disjoint(_parts(spark, sf_dir), 40, 30, "seed")
    return train.select("surface", F.lit("train").alias("split")).union(test.select("surface", F.lit("test").alias("split")))


def sized_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = catalog.names_glossary(spark, sf_dir).select("entry_id", "surface")
    entries = catalog.words(spark, sf_dir).select(F.col("word").alias("entry_id"), F.col("word").alias("surface"))
    return glossary.sized(names.select(F.col("entry_id").cast("string").alias("entry_id"), "surface"), entries, 200, "seed").select("surface", F.col("place").cast("long").alias("place"))


def carrier_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = catalog.names_glossary(spark, sf_dir).select("entry_id", "surface")
    terms = glossary.sized(names, names.limit(0), names.count(), "seed")
    return synthesis.sentences(terms, TEMPLATES, 500, "seed").select("id", "text", F.array_join("terms", "|").alias("terms"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with phrases that were not said, other digits, or little left of them."""
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("gold"))
    n = F.col("conv_id") * 7 + F.col("turn")
    heard = F.when(n % 5 == 0, F.concat("gold", F.lit(hallucination.PHRASES[0]))).when(n % 5 == 1, F.concat(F.lit("7"), "gold")).when(n % 5 == 2, F.lit("short")).when(n % 5 == 3, F.replace("gold", F.lit("e"), F.lit("a"))).otherwise(F.col("gold"))
    return rows.withColumn("heard", heard).withColumn("found", synthesis.labels(F.col("gold"), F.col("heard"), F.array(F.when(F.contains("gold", F.lit("the")), "the").otherwise(""))))


def pathology_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("conv_id", "turn", F.array_join("found", "|").alias("labels"))


def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.statistics(_labelled(spark, sf_dir).withColumnRenamed("found", "error_types"))


def pathology_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which turns of conversations each probe, label and condition is dealt to, turn by turn, and how many these are."""
    probes = synthesis.silence_probes(spark).select(F.concat_ws(":", "kind", F.col("seconds").cast("string"), F.col("snr_db").cast("string")).alias("name"), F.lit("probe").alias("table"))
    labels = synthesis.pathologies(spark).select(F.col("label").alias("name"), F.lit("label").alias("table"))
    names = probes.union(labels).union(synthesis.conditions(spark).select(F.col("label"), F.lit("condition")))
    w = Window.partitionBy("table")  # some twenty names each
    names = names.withColumn("place", F.row_number().over(w.orderBy("name")) - 1).withColumn("n", F.count("*").over(w))
    sizes = names.select("table", "n").distinct()
    turns = _read(spark, sf_dir, "conversations").select((F.col("conv_id") * 7 + F.col("turn")).alias("k"), F.explode(F.array(*map(F.lit, ("probe", "label", "condition")))).alias("table"))
    dealt = turns.join(F.broadcast(sizes), "table").groupBy("table", (F.col("k") % F.col("n")).alias("place")).agg(F.count("*").alias("turns"))
    return names.join(dealt, ["table", "place"], "left").select("name", "table", F.coalesce("turns", F.lit(0)).cast("long").alias("turns"))


def cost_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every confusion with its cost, and how often the words of the benchmark have either sound."""
    rows = spark.createDataFrame(S.cost_model(), "cost double, a string, b string")
    heard = catalog.words(spark, sf_dir).select(F.explode("phonemes").alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    for c in ("a", "b"):
        rows = rows.join(heard.select(F.col("p").alias(c), F.col("n").alias(f"n_{c}")), c, "left")
    return rows.select("cost", "a", "b", *(F.coalesce(f"n_{c}", F.lit(0)).cast("long").alias(f"n_{c}") for c in ("a", "b")))


def exact_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canned phrases removed where they are whole segments, exact ones only."""
    docs = catalog._transcripts(spark, sf_dir)
    return hallucination.remove(docs, hallucination.find(docs, hallucination.FilterConfig(tau=0.0))).select("doc_id", "text")


def closest_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each benchmark text sounds most like each of the longest part names."""
    docs, tokens = catalog._unspaced(spark, sf_dir)
    names = catalog.names_glossary(spark, sf_dir).where(F.length("surface") >= 11).select(F.col("surface").alias("term"), F.get("readings", F.lit(0)).alias("reading"))
    asked = docs.select("doc_id").join(F.broadcast(names))  # a few names
    return prompts.closest_spans(tokens.withColumn("surface", F.lit("")), asked, 0.6).select("doc_id", "term", "start", F.col("end").alias("stop"), F.round("nd", 6).alias("nd"))


def span_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correction.span_counts(*catalog._unspaced(spark, sf_dir), catalog._kana_glossary(spark, sf_dir))


def correction_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence for every proposal, its alignment as a line."""
    rows = correction.explain(*catalog._unspaced(spark, sf_dir), catalog._kana_glossary(spark, sf_dir))
    line = F.array_join(F.transform("alignment", lambda o: F.concat(o["a"], o["op"], o["b"])), " ")
    return rows.select("doc_id", "start", F.col("end").alias("stop"), "span", "replacement", F.round("nd", 6).alias("nd"), "accepted", "applied", "reason", line.alias("alignment"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        tokenize, char_kind_histogram, wer_tokens, corpus_wer, term_recall_by_category, term_damage, metric_summary, hallucination_rate, index_stats, screen_spans, topk_indexed, retrieval_recall, logistic_gate, gate_sweep,
        pick_threshold, prompt_capacity, candidate_pattern, missing_readings, synthetic_glossary, disjoint_glossaries, sized_glossary, carrier_sentences, pathology_labels, label_histogram, pathology_tables,
        cost_model, exact_removal, closest_spans, span_counts, correction_receipts,
    )
    return {f.__name__: f for f in own}


def _kind_sql(c: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({c}, '^[{inside}]$') THEN '{'punct' if name == 'mark' else name}'" for name, inside in characters.CLASSES.items())
    return f"CASE {cases} ELSE 'other' END"


def oracle_sql() -> dict[str, str]:
    q = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    letter_names = f"map({q(S.LETTER_NAMES)}, {q(S.LETTER_NAMES.values())})"
    digit_names = f"map({q(S.DIGIT_NAMES)}, {q(S.DIGIT_NAMES.values())})"
    spoken = lambda c, names: f"array_to_string(list_transform(regexp_extract_all(lower({c}), '(?s).'), lambda x: coalesce({names}[x], '')), '')"
    places = lambda text, term: f"CAST((length({text}) - length(replace({text}, {term}, ''))) // length({term}) AS BIGINT)"
    text = "coalesce(text, '')"
    any_char = r"[\x{0}-\x{10FFFF}]"
    units = lambda c: f"regexp_extract_all({c}, '{characters.UNIT}')"
    # each distinct unit of a pair as one ASCII character: texts of the benchmark have fewer than 120
    known = "list_distinct(list_concat(r, h))"
    spell = lambda c: f"array_to_string(list_transform({c}, lambda u: chr(CAST(list_position(k, u) AS INT))), '')"
    unit_rows = lambda rows, h: f"SELECT {rows}, r, h, {known} AS k FROM (SELECT *, {units('reference')} AS r, {units(h)} AS h FROM heard)"
    counted = f"counted AS (SELECT term, category, {places('reference', 'term')} AS g, least({places('reference', 'term')}, {places('baseline', 'term')}) AS b, least({places('reference', 'term')}, {places('corrected', 'term')}) AS c FROM heard, terms WHERE contains(reference, term))"
    ph = q(hallucination.PHRASES)
    transcripts = f"t AS (SELECT p_partkey AS doc_id, p_name, p_name || '。' || {ph}[p_partkey % 20 + 1] || '。' || CASE WHEN p_partkey % 3 = 0 THEN {ph}[p_partkey % 20 + 1] || '。' ELSE '' END AS text FROM part)"
    words = f"words AS MATERIALIZED (SELECT word, {catalog.phonemes_sql(catalog.kana_sql('word'))} AS ph FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark))"
    names = f"names AS MATERIALIZED (SELECT p_name, {catalog.phonemes_sql(catalog.kana_sql('p_name'))} AS ph FROM (SELECT DISTINCT p_name FROM part))"
    grams = lambda n: f"list_transform(range(1, len(p) - {n - 2}), lambda i: array_to_string(p[i:i + {n - 1}], '+'))"
    index = f"""{words}, padded AS (SELECT word, len(ph) AS n, list_concat(['^'], ph, ['$']) AS p FROM words WHERE len(ph) > 0 AND len(list_filter(ph, lambda x: x <> '?')) > 0),
posted AS (SELECT word, n, unnest(list_distinct(CASE WHEN n >= 4 THEN list_concat({grams(2)}, {grams(3)}) ELSE {grams(2)} END)) AS gram FROM padded)"""
    z = " + ".join(f"({'0.0' if n == 'span_is_glossary_surface' else f'(p_partkey % {i + 2}) / 7.0::DOUBLE'} - {m!r}::DOUBLE) / {s!r}::DOUBLE * {w!r}::DOUBLE" for i, (n, w, m, s) in enumerate(zip(gates.FEATURES, GATE.weights, GATE.mean, GATE.scale, strict=True)))
    outcomes = f"outcomes AS (SELECT ((p_partkey * 37 + p_size * 11) % 1009) / 1009::DOUBLE AS p, {q(OUTCOMES)}[(p_partkey + p_size) % 7 + 1] AS o FROM part)"
    sweep = f"""{outcomes}, i AS (SELECT unnest(range(0, 101)) AS i), c AS (SELECT i, count(o) AS n, count(*) FILTER (o = 'repair') AS r, count(*) FILTER (o = 'damage') AS d FROM i LEFT JOIN outcomes ON p >= i / 100 GROUP BY i),
s AS (SELECT i / 100 AS threshold, n AS accepted, r AS repairs, d AS damages, n - r - d AS neutrals, r / (SELECT count(*) FROM outcomes WHERE o = 'repair') AS correction_rate, d / (SELECT count(*) FROM outcomes WHERE o IN ('damage', 'no-op')) AS damage_rate, CASE WHEN n = 0 THEN 0 ELSE d / n END AS edit_damage_rate FROM c)"""
    draw = lambda *parts: f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT / {float(1 << 52)!r}::DOUBLE"
    parts_sql = """two AS (SELECT string_split(p_name, ' ') AS w FROM part WHERE len(string_split(p_name, ' ')) = 2),
made AS (SELECT surface, min({'category': category, 'share': share, 'weight': weight, 'reading': reading}) AS m FROM (
  SELECT DISTINCT a.w[1] || b.w[2] AS surface, upper(a.w[1]) || upper(b.w[2]) AS reading, 'product' AS category, 0.6::DOUBLE AS share, 1.0::DOUBLE AS weight FROM two a, two b
  UNION ALL SELECT DISTINCT a.w[2] || lower(p_type), upper(a.w[2]) || upper(lower(p_type)), 'org', 0.4::DOUBLE, 0.9::DOUBLE FROM two a, (SELECT DISTINCT p_type FROM part)) GROUP BY surface)"""
    turn = lambda seed: f"-ln(greatest({draw(repr(seed), 'm.category', 'surface')}, 1e-18::DOUBLE)) / m.share"
    order = "md5('seed|' || surface)"
    first_key = "SELECT p_name AS surface, min(p_partkey) AS entry_id FROM part GROUP BY p_name"
    sql_list = "[" + ", ".join(f"'{t}'" for t in TEMPLATES) + "]"
    pick = lambda what, most: f"CAST(floor({draw(repr('seed'), repr(what), 'CAST(id AS VARCHAR)')} * {most}) AS BIGINT)"
    labelled = f"""rows AS (SELECT conv_id, turn, coalesce(text, '') AS gold, (conv_id * 7 + turn) % 5 AS n FROM conversations),
heard AS (SELECT *, CASE n WHEN 0 THEN gold || '{hallucination.PHRASES[0]}' WHEN 1 THEN '7' || gold WHEN 2 THEN 'short' WHEN 3 THEN replace(gold, 'e', 'a') ELSE gold END AS heard FROM rows),
flags AS (SELECT *, contains(gold, 'the') AND NOT contains(heard, 'the') AS missing, length(heard) < length(gold) * 0.85::DOUBLE AS short, regexp_extract_all(gold, '[0-9０-９]') <> regexp_extract_all(heard, '[0-9０-９]') AS digits,
  len(list_filter({ph}, lambda p: contains(heard, p) AND NOT contains(gold, p))) > 0 AS made_up FROM heard),
found AS (SELECT conv_id, turn, list_filter([CASE WHEN made_up THEN 'hallucination' END, CASE WHEN digits THEN 'number-unit' END, CASE WHEN missing OR (NOT missing AND NOT short AND NOT digits AND NOT made_up AND gold <> heard) THEN 'term-phonetic' END, CASE WHEN short THEN 'word-drop' END], lambda x: x IS NOT NULL) AS labels FROM flags)"""
    probes = [("silence", s, None) for s in synthesis.SILENCES] + [("noise", s, level) for s in synthesis.NOISES for level in synthesis.NOISE_LEVELS]
    rows = [(f"{k}:{s}" + (f":{x}" if x is not None else ""), "probe") for k, s, x in probes] + [(x[0], "label") for x in synthesis.PATHOLOGIES] + [(x[4], "condition") for x in synthesis.CONDITIONS]
    rate = lambda a, b: f"round(CASE WHEN {b} = 0 THEN 0 ELSE {a} / {b} END::DOUBLE, 9)"
    return {
        "tokenize": f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{characters.TOKEN}') AS w FROM documents), e AS (SELECT doc_id, unnest(w) AS surface, unnest(range(0, len(w))) AS tok FROM d),
p AS (SELECT *, sum(length(surface)) OVER (PARTITION BY doc_id ORDER BY tok) AS stop, {_kind_sql('substr(surface, 1, 1)')} AS kind FROM e)
SELECT doc_id, CAST(tok AS INT) AS tok, surface, CAST(stop - length(surface) AS INT) AS start, CAST(stop AS INT) AS stop, kind,
  CASE WHEN kind = 'latin' THEN {spoken('surface', letter_names)} WHEN kind = 'digit' THEN {spoken('surface', digit_names)} WHEN kind IN ('hiragana', 'katakana') THEN surface ELSE '' END AS reading FROM p""",
        "char_kind_histogram": f"WITH c AS (SELECT unnest(regexp_extract_all(coalesce(text, ''), '{any_char}')) AS c FROM documents), n AS (SELECT c, count(*) AS n FROM c GROUP BY c) SELECT {_kind_sql('c')} AS kind, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY 1",
        "wer_tokens": f"WITH u AS (SELECT doc_id, {units(text)} AS u FROM documents) SELECT doc_id, CAST(len(u) AS BIGINT) AS units, md5(array_to_string(u, '|')) AS digest FROM u",
        "corpus_wer": f"""WITH {_HEARD}, u AS ({unit_rows('item_id % 4 AS part', 'baseline')}), s AS (SELECT part, sum(levenshtein({spell('r')}, {spell('h')})) AS e, sum(len(r)) AS w FROM u GROUP BY part)
SELECT part, CAST(e AS BIGINT) AS edits, CAST(w AS BIGINT) AS words, {rate('e', 'w')} AS wer FROM s""",
        "term_recall_by_category": f"WITH {_HEARD}, {_TERMS}, {counted}, s AS (SELECT category, sum(b) AS f, sum(g) AS t FROM counted GROUP BY category) SELECT category, CAST(f AS BIGINT) AS found, CAST(t AS BIGINT) AS total, {rate('f', 't')} AS recall FROM s",
        "term_damage": f"""WITH {_HEARD}, {_TERMS}, {counted}, s AS (SELECT coalesce(sum(b), 0) AS b, coalesce(sum(greatest(0, b - c)), 0) AS x, coalesce(sum(greatest(0, c - b)), 0) AS f FROM counted)
SELECT CAST(b AS BIGINT) AS correct_before, CAST(x AS BIGINT) AS broken, CAST(f AS BIGINT) AS fixed, {rate('x', 'b')} AS damage_rate FROM s""",
        "metric_summary": f"""WITH {_HEARD}, {_TERMS}, {counted}, ub AS ({unit_rows('item_id', 'baseline')}), uc AS ({unit_rows('item_id', 'corrected')}),
m AS (SELECT (SELECT count(*) FROM heard) AS n, (SELECT sum(levenshtein(reference, corrected)) / sum(length(reference)) FROM heard) AS cer, (SELECT sum(levenshtein(reference, baseline)) / sum(length(reference)) FROM heard) AS cer_baseline,
  (SELECT sum(levenshtein({spell('r')}, {spell('h')})) / sum(len(r)) FROM uc) AS wer, (SELECT sum(levenshtein({spell('r')}, {spell('h')})) / sum(len(r)) FROM ub) AS wer_baseline,
  (SELECT sum(c) / sum(g) FROM counted) AS term_recall, (SELECT sum(b) / sum(g) FROM counted) AS term_recall_baseline)
SELECT n, round(cer, 9) AS cer, round(cer_baseline, 9) AS cer_baseline, round(wer, 9) AS wer, round(wer_baseline, 9) AS wer_baseline, round(term_recall, 9) AS term_recall, round(term_recall_baseline, 9) AS term_recall_baseline,
  round(cer_baseline - cer, 9) AS cer_improvement, round(term_recall - term_recall_baseline, 9) AS term_recall_gain, round((cer_baseline - cer) / cer_baseline, 9) AS cer_improvement_rel FROM m""",
        "hallucination_rate": f"""WITH {transcripts}, h AS (SELECT CASE WHEN doc_id % 5 = 0 THEN text ELSE p_name END AS r, text AS b, CASE WHEN doc_id % 7 = 0 THEN text ELSE p_name END AS c, unnest({ph}) AS p FROM t),
n AS (SELECT {places('r', 'p')} AS r, {places('b', 'p')} AS b, {places('c', 'p')} AS c FROM h),
s AS (SELECT sum(greatest(0, b - r)) AS a, sum(greatest(0, least(greatest(0, b - r), b - c))) AS x, sum(r) AS l, sum(CASE WHEN r > 0 THEN greatest(0, least(r, b) - c) ELSE 0 END) AS f FROM n)
SELECT CAST(a AS BIGINT) AS hallucinations, CAST(x AS BIGINT) AS removed, CAST(l AS BIGINT) AS legitimate, CAST(f AS BIGINT) AS false_removals, {rate('x', 'a')} AS removal_rate, {rate('f', 'l')} AS false_removal_rate FROM s""",
        "index_stats": f"""WITH {index}, s AS (SELECT gram, count(*) AS n FROM posted GROUP BY gram)
SELECT (SELECT count(*) FROM words) AS entries, (SELECT count(*) FROM padded) AS indexed_readings, (SELECT count(*) FROM padded) AS reachable_terms, count(*) AS grams, round(avg(n), 9) AS mean_posting, max(n) AS max_posting,
  (SELECT CAST(min(n) AS INT) FROM padded) AS shortest, (SELECT CAST(max(n) AS INT) FROM padded) AS longest FROM s""",
        "screen_spans": f"""WITH {index}, {names}, b AS (SELECT min(n) AS lo, max(n) AS hi FROM padded), a AS (SELECT p_name, len(ph) AS n, list_concat(['^'], ph, ['$']) AS p FROM names),
near AS (SELECT a.* FROM a, b WHERE n > 0 AND n + 0.28::DOUBLE * greatest(n, hi) / 0.15::DOUBLE >= lo AND n - 0.28::DOUBLE * greatest(n, hi) / 0.15::DOUBLE <= hi),
g AS (SELECT p_name, unnest({grams(2)}) AS gram, n + 1 AS all_grams FROM near), hits AS (SELECT p_name, count(*) AS h, any_value(all_grams) AS k FROM g WHERE gram IN (SELECT gram FROM posted) GROUP BY p_name)
SELECT p_name AS name FROM near WHERE n < 3 UNION ALL SELECT near.p_name FROM near JOIN hits ON near.p_name = hits.p_name WHERE n >= 3 AND h >= greatest(1, floor(k * 0.34::DOUBLE))""",
        "logistic_gate": f"SELECT p_partkey, round(CASE WHEN p_size % 11 = 0 THEN 0 ELSE 1 / (1 + exp(-(0.8::DOUBLE * ({z} + 0.3::DOUBLE) - 0.1::DOUBLE))) END::DOUBLE, 9) AS probability FROM part",
        "gate_sweep": f"WITH {sweep} SELECT threshold, accepted, repairs, damages, neutrals, round(correction_rate, 9) AS correction_rate, round(damage_rate, 9) AS damage_rate, round(edit_damage_rate, 9) AS edit_damage_rate FROM s",
        "pick_threshold": f"WITH {sweep}, best AS (SELECT max(correction_rate) AS b FROM s WHERE damage_rate <= 0.1::DOUBLE) SELECT coalesce((SELECT max(threshold) FROM s, best WHERE damage_rate <= 0.1::DOUBLE AND (b <= 0 OR correction_rate >= b * 0.98::DOUBLE - 1e-9::DOUBLE)), (SELECT max(threshold) FROM s)) AS threshold",
        "prompt_capacity": f"""WITH RECURSIVE n AS (SELECT row_number() OVER (ORDER BY entry_id) AS i, entry_id, surface, greatest(1, CAST(round_even(2 * len(regexp_extract_all(surface, '[A-Za-z]')) * 0.25::DOUBLE + 2 * len(regexp_extract_all(surface, '[^A-Za-z]')) + 3, 0) AS BIGINT)) AS cost FROM ({first_key})),
r AS (SELECT 0::BIGINT AS i, 0::BIGINT AS used, false AS taken UNION ALL SELECT n.i, CASE WHEN used + cost <= 100 THEN used + cost ELSE used END, used + cost <= 100 FROM r JOIN n ON n.i = r.i + 1)
SELECT entry_id, surface, (SELECT max(used) FROM r) AS used, (SELECT count(*) FROM n) AS entries FROM r JOIN n USING (i) WHERE taken""",
        "candidate_pattern": "WITH c AS (SELECT p_type, list_sort(list_distinct(list(p_brand))) AS c FROM part GROUP BY p_type) SELECT p_type, '^(?:' || array_to_string(list_transform(c, lambda x: regexp_replace(x, '([^\\w\\s]|\\s)', '\\\\\\1', 'g')), '|') || ')$' AS pattern, c[1] AS first FROM c",
        "missing_readings": f"SELECT word AS surface, {spoken('word', letter_names)} AS reading, CAST(0 AS INT) AS aliases FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark)",
        "synthetic_glossary": f"WITH {parts_sql} SELECT surface, m.reading AS reading, m.category AS category, m.weight AS weight FROM made ORDER BY {turn('seed')}, surface LIMIT 60",
        "disjoint_glossaries": f"""WITH {parts_sql}, train AS (SELECT surface, m.reading AS reading FROM made ORDER BY {turn('seed')}, surface LIMIT 40),
test AS (SELECT surface FROM made WHERE surface NOT IN (SELECT surface FROM train) AND m.reading NOT IN (SELECT reading FROM train) ORDER BY {turn('seed|test')}, surface LIMIT 30)
SELECT surface, 'train' AS split FROM train UNION ALL SELECT surface, 'test' FROM test""",
        "sized_glossary": f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS surface FROM benchmark), names AS ({first_key})
SELECT surface, row_number() OVER (ORDER BY {order}, surface) - 1 AS place FROM (SELECT surface FROM names UNION ALL (SELECT surface FROM w WHERE surface NOT IN (SELECT surface FROM names) ORDER BY surface LIMIT 200 - (SELECT count(*) FROM names)))""",
        "carrier_sentences": f"""WITH names AS (SELECT surface, row_number() OVER (ORDER BY {order}, surface) - 1 AS place FROM ({first_key})), ids AS (SELECT unnest(range(0, 500)) AS id), c AS (SELECT count(*) AS n FROM names),
r AS (SELECT id, {sql_list}[{pick('template', len(TEMPLATES))} + 1] AS t, {pick('T0', 'c.n')} AS p0, {pick('T1', 'c.n')} AS p1, {pick('N2', 28)} + 1 AS n2, {pick('N', 98)} + 2 AS n FROM ids, c)
SELECT id, replace(replace(replace(replace(t, '{{T0}}', a.surface), '{{T1}}', b.surface), '{{N2}}', CAST(n2 AS VARCHAR)), '{{N}}', CAST(r.n AS VARCHAR)) AS text, CASE WHEN a.surface = b.surface THEN a.surface ELSE a.surface || '|' || b.surface END AS terms
FROM r JOIN names a ON a.place = p0 JOIN names b ON b.place = p1""",
        "pathology_labels": f"WITH {labelled} SELECT conv_id, turn, array_to_string(labels, '|') AS labels FROM found",
        "label_histogram": f"WITH {labelled}, e AS (SELECT unnest(labels) AS label FROM found) SELECT label, count(*) AS pairs FROM e GROUP BY label",
        "pathology_tables": f"""WITH v AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{a}{chr(39)}, {chr(39)}{b}{chr(39)})' for a, b in rows)}) AS v(name, t)),
n AS (SELECT name, t, row_number() OVER (PARTITION BY t ORDER BY name) - 1 AS place, count(*) OVER (PARTITION BY t) AS n FROM v)
SELECT name, t AS "table", (SELECT count(*) FROM conversations WHERE (conv_id * 7 + turn) % n.n = place) AS turns FROM n""",
        "cost_model": f"""WITH {words}, v AS (SELECT * FROM (VALUES {', '.join(f'({c!r}::DOUBLE, {chr(39)}{a}{chr(39)}, {chr(39)}{b}{chr(39)})' for (a, b), c in S.confusions().items())}) AS v(cost, a, b)),
p AS (SELECT unnest(ph) AS p FROM words), n AS (SELECT p, count(*) AS n FROM p GROUP BY p)
SELECT cost, a, b, coalesce((SELECT n FROM n WHERE p = a), 0) AS n_a, coalesce((SELECT n FROM n WHERE p = b), 0) AS n_b FROM v""",
        "exact_removal": f"""WITH {transcripts}, k AS (SELECT *, {ph}[doc_id % 20 + 1] AS p FROM t)
SELECT doc_id, CASE WHEN p NOT IN ({', '.join(repr(x) for x in hallucination.ORDINARY)}) OR doc_id % 3 = 0 THEN trim(p_name || '。') ELSE text END AS text FROM k""",
    }
