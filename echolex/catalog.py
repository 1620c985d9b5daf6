"""All queries of the library by name, and SQL that gives the same rows.

The tables hold no Japanese, so words become kana by a fixed letter-to-kana projection, which both engines can do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolex.functions import sound_tables as S
from echolex.functions import sounds
from echolex.functions.columns import once
from echolex.functions.characters import CLASSES
from echolex.functions.cost_model import DEFAULT, CostModel
from echolex.operators import correction, edits, glossary, hallucination, lookup, measures

LETTERS, KANA = "abcdefghijklmnopqrstuvwxyz", "アキシリエフッャイョカーュンオコトウステセヴァナマド"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def as_kana(text: str) -> Column:
    return F.translate(F.lower(text), LETTERS, KANA)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ASCII words of the benchmark texts, with phonemes."""
    found = _read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return once(found, phonemes=sounds.phonemes(as_kana("word")))


def names_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part names as a glossary."""
    g = _read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("surface")).agg(F.min("p_partkey").alias("entry_id"), F.max("p_size").cast("double").alias("weight"))
    return g.withColumn("readings", F.array(as_kana("surface")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which glossary term does each distinct word sound like? Top five, all terms whose length allows a match."""
    asked = words(spark, sf_dir).select(F.col("word").alias("q_key"), "phonemes")
    found = lookup.top_k(asked, lookup.readings(names_glossary(spark, sf_dir)), lookup.QueryBounds(tau=0.6), exhaustive=True)
    return found.select(F.col("q_key").alias("word"), "rank", "entry_id", "surface", F.round("raw", 6).alias("raw"), F.round("nd", 6).alias("nd"))


def phonemes_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("word", F.array_join("phonemes", " ").alias("phonemes"), sounds.mora_count("phonemes").alias("morae"))


def indel_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = sounds.indel_costs("phonemes")
    return words(spark, sf_dir).select("word", F.round(F.aggregate(costs, F.lit(0.0), lambda a, c: a + c), 6).alias("total"), F.array_min(costs).alias("least"), F.array_max(costs).alias("most"))


def phoneme_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("word", F.replace(F.array_join(sounds.phoneme_ngrams("phonemes", 2), "|"), F.lit("\u001f"), F.lit("+")).alias("grams"))


def normalized_distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of part names in order, within the same first letter."""
    g = names_glossary(spark, sf_dir).select(F.col("surface").alias("a"), sounds.phonemes(as_kana("surface")).alias("pa"))
    h = g.withColumnsRenamed({"a": "b", "pa": "pb"})
    pairs = g.join(h, (F.substring("a", 1, 1) == F.substring("b", 1, 1)) & (F.col("a") < F.col("b")))
    return pairs.select("a", "b", F.round(sounds.normalized_distance("pa", "pb"), 6).alias("nd"))


def bounded_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs' distance by the second name's length and by their mean length, where it is at most 0.4."""
    g = names_glossary(spark, sf_dir).select(F.col("surface").alias("a"), sounds.phonemes(as_kana("surface")).alias("pa"))
    h = g.withColumnsRenamed({"a": "b", "pa": "pb"})
    pairs = g.join(h, (F.substring("a", 1, 1) == F.substring("b", 1, 1)) & (F.col("a") < F.col("b")))
    return pairs.select("a", "b", *(F.round(sounds.bounded_normalized_distance("pa", "pb", 0.4, by), 6).alias(f"by_{by}") for by in ("term", "mean")))


def gram_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = words(spark, sf_dir).select(F.xxhash64("word").alias("entry_id"), F.col("word").alias("surface"), F.lit(1.0).alias("weight"), F.array(as_kana("word")).alias("readings"))
    return lookup.gram_stats(lookup.readings(g)).select(F.replace("gram", F.lit("\u001f"), F.lit("+")).alias("gram"), "df", F.round("idf", 9).alias("idf"))


def glossary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("surface"), F.col("p_type").alias("reading"), F.array("p_brand").alias("aliases"), F.col("p_brand").alias("category"), F.col("p_size").cast("double").alias("weight"))
    return glossary.merge(rows).withColumn("aliases", F.array_join("aliases", "|"))


def glossary_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.subset(_read(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("surface")), 50, "seed")


def _heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("word"))


def surface_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("word").join(_heard(spark, sf_dir), "word", "left_semi")


def surface_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("word").join(_heard(spark, sf_dir), "word", "left_anti")


def cer_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _read(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("reference"), F.col("p_type").alias("hypothesis"))
    return measures.corpus_cer(pairs, "p_brand").withColumn("cer", F.round("cer", 9))


def term_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of five terms, by language, after a corruption that loses some of them."""
    terms = spark.createDataFrame([(x,) for x in ("the", "und", "les", "que", "ing")], "term string")
    d = _read(spark, sf_dir, "documents").select("lang", F.coalesce("text", F.lit("")).alias("reference")).withColumn("hypothesis", F.replace("reference", F.lit(" the "), F.lit(" teh ")))
    rows = measures.term_recall(d, terms, ["lang", "term"])
    return rows.select("lang", "term", F.col("total").alias("gold"), "found", F.round("recall", 9).alias("recall"))


def token_count_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", measures.count_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


def hallucination_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = F.filter(F.split(F.coalesce("text", F.lit("")), "[。．.\n\r！!？?]+"), lambda x: x != "")
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(segments).cast("long").alias("segments"), F.coalesce(F.array_max(F.transform(segments, F.length)), F.lit(0)).cast("long").alias("longest"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 101 / 100).alias("score"))
    return _read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id")


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.roc_auc(_scored(spark, sf_dir)).select(F.round("auc", 9).alias("auc"))


def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.expected_calibration_error(_scored(spark, sf_dir)).select(F.round("ece", 9).alias("ece"))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.sweep_thresholds(_scored(spark, sf_dir))


def heuristic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    f = {"norm_distance": F.col("p_size") / 100.0, "margin": F.col("p_partkey") % 10 / 10.0, "span_morae": F.length("p_name").cast("double"), "unknown_ratio": F.col("p_partkey") % 3 / 10.0, "span_is_common_word": (F.col("p_partkey") % 2).cast("double")}
    return p.select("p_partkey", F.round(measures.heuristic_gate(f), 9).alias("probability"))


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names, each followed by a canned phrase, and every third by that phrase again."""
    phrases = F.array(*map(F.lit, hallucination.PHRASES))
    p = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_name", F.get(phrases, (F.col("p_partkey") % len(hallucination.PHRASES)).cast("int")).alias("phrase"))
    again = F.when(F.col("doc_id") % 3 == 0, F.concat("phrase", F.lit("。"))).otherwise("")
    return p.select("doc_id", F.concat("p_name", F.lit("。"), "phrase", F.lit("。"), again).alias("text"))


def hallucination_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact matches only, so that SQL can give them too."""
    hits = hallucination.find(_transcripts(spark, sf_dir), hallucination.FilterConfig(tau=0.0))
    return hits.select("doc_id", "start", F.col("end").alias("stop"), "pattern", F.array_join("evidence", "|").alias("evidence"), "score")


def hallucination_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _transcripts(spark, sf_dir)
    return hallucination.remove(docs, hallucination.find(docs))


def edit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return p.select("p_partkey", edits.classify_edit(F.col("p_name"), F.col("p_type"), F.col("p_brand")).alias("outcome"))


def resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("l_linenumber") * 3).cast("int")
    spans = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), start.alias("start"), (start + 1 + (F.col("l_quantity") % 7).cast("int")).alias("end"), F.col("l_extendedprice").cast("double").alias("score"))
    return edits.resolve_overlaps(spans).withColumnRenamed("end", "stop")


def _unspaced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The benchmark texts as kana without blanks, and their tokens: words, of which those up to two letters count as affixes, and marks."""
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[a-z]+|[^a-z\s]"), F.lit(0))
    rows = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), found.alias("words"))
    before = Window.partitionBy("doc_id").orderBy("tok").rowsBetween(Window.unboundedPreceding, -1)
    tokens = rows.select("doc_id", F.posexplode("words").alias("tok", "word")).withColumn("start", F.coalesce(F.sum(F.length("word")).over(before), F.lit(0)).cast("int"))
    letters = F.rlike("word", F.lit("^[a-z]"))
    tokens = tokens.select("doc_id", "tok", "start", (F.col("start") + F.length("word")).alias("end"), F.when(letters, "katakana").otherwise("punct").alias("kind"), F.array(as_kana("word")).alias("readings"), (letters & (F.length("word") <= 2)).alias("blocked"), F.lit(False).alias("common"), F.lit(False).alias("proper"))
    return rows.select("doc_id", as_kana(F.array_join("words", "")).alias("text")), tokens


def _kana_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longer words, to be written in hiragana."""
    long = words(spark, sf_dir).where(F.length("word") >= 4)
    return long.select(F.crc32("word").alias("entry_id"), sounds.to_hiragana(as_kana("word")).alias("surface"), F.array(as_kana("word")).alias("readings"), F.length("word").cast("double").alias("weight"))


def span_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correction.spans(*_unspaced(spark, sf_dir)).select("doc_id", "start", F.col("end").alias("stop"), "span")


def correction_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = correction.proposals(*_unspaced(spark, sf_dir), _kana_glossary(spark, sf_dir))
    return found.withColumnRenamed("end", "stop").drop("phonemes", "t_phonemes", "features")


def corrected_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correction.correct(*_unspaced(spark, sf_dir), _kana_glossary(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (bounded_distance, span_enumeration, phonemes_of_words, indel_profile, phoneme_ngrams, normalized_distance_pairs, gram_idf, glossary_merge, glossary_subset, surface_semi_join, surface_anti_join, cer_by_brand, term_recall, token_count_estimate, hallucination_segments, roc_auc, calibration_error, threshold_sweep, heuristic_gate, hallucination_hits, edit_outcomes)
    return {"topk_exhaustive": flagship} | {f.__name__: f for f in own}


def queries_without_sql() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries that SQL can't express plainly; their operators are held against brute force and goldens in tests."""
    return {f.__name__: f for f in (hallucination_removal, resolve_overlaps, correction_proposals, corrected_transcripts)}


def _lists(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def kana_sql(c: str) -> str:
    return f"translate(lower({c}), '{LETTERS}', '{KANA}')"


def phonemes_sql(kana: str, model: CostModel = DEFAULT) -> str:
    """The phonemes of a reading, as SQL."""
    table, vowels = S.tokens(model), "('a', 'i', 'u', 'e', 'o')"
    keys = _lists(list(table))
    values = "[" + ", ".join(_lists(v) + "::VARCHAR[]" for v in table.values()) + "]"
    parts = f"regexp_extract_all({kana}, '(?:{'|'.join(S.digraphs())}|.)')"
    out = f"flatten(list_transform({parts}, lambda t: coalesce(map({keys}, {values})[t], ['?'])))"
    each = "list_reduce(list_transform({0}, lambda x: [x]), lambda acc, p: {1}, []::VARCHAR[])"
    if model.expand_long_vowel_mark:
        out = each.format(out, f"CASE WHEN p[1] <> 'R' THEN list_append(acc, p[1]) WHEN len(acc) > 0 AND acc[-1] IN {vowels} THEN list_append(acc, acc[-1]) ELSE acc END")
    pairs = [f"(acc[-1] = '{x}' AND p[1] = '{y}')" for x, y, on in (("o", "u", model.fold_ou_to_oo), ("e", "i", model.fold_ei_to_ee)) if on]
    if pairs:
        out = each.format(out, f"CASE WHEN len(acc) > 0 AND ({' OR '.join(pairs)}) THEN list_append(acc, acc[-1]) ELSE list_append(acc, p[1]) END")
    if model.collapse_long_vowels:
        out = each.format(out, f"CASE WHEN len(acc) > 0 AND acc[-1] = p[1] AND p[1] IN {vowels} THEN acc ELSE list_append(acc, p[1]) END")
    return out


def indel_sql(ph: str, m: CostModel = DEFAULT) -> str:
    """Costs of inserting or deleting each phoneme, as SQL."""
    vowels, at = "('a', 'i', 'u', 'e', 'o')", lambda d: f"coalesce({ph}[i {d}], '')"
    return f"""list_transform(range(1, len({ph}) + 1), lambda i: CASE WHEN {ph}[i] = '?' THEN {m.indel_unknown} WHEN {ph}[i] = 'Q' THEN {m.indel_Q} WHEN {ph}[i] = 'N' THEN {m.indel_N} WHEN {ph}[i] = 'R' THEN {m.indel_R}
          WHEN {ph}[i] IN {vowels} THEN CASE WHEN (i > 1 AND {at('- 1')} = {ph}[i]) OR {at('+ 1')} = {ph}[i] THEN {m.indel_long_vowel} WHEN i > 1 AND {ph}[i] = 'u' AND list_contains({_lists(S.EPENTHESIS_U)}, {at('- 1')}) THEN {m.indel_epenthetic}
            WHEN i > 1 AND {ph}[i] = 'i' AND list_contains({_lists(S.EPENTHESIS_I)}, {at('- 1')}) THEN {m.indel_epenthetic} ELSE {m.indel_vowel} END
          WHEN {ph}[i] IN ('y', 'w') THEN {m.indel_glide} ELSE {m.indel_consonant} END::DOUBLE)"""


def oracle_sql() -> dict[str, str]:
    table = S.tokens()
    vowels = "('a', 'i', 'u', 'e', 'o')"

    indel, m = indel_sql, DEFAULT
    costs = S.confusions()
    cost_map = f"map({_lists([f'{a}|{b}' for a, b in costs])}, [{', '.join(f'{c}::DOUBLE' for c in costs.values())}])"
    words_cte = f"""raw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark),
words AS MATERIALIZED (SELECT word, {phonemes_sql(kana_sql('word'))} AS ph FROM raw)"""
    special = "('a', 'i', 'u', 'e', 'o', 'N', 'Q', 'R')"
    symbol = f"CASE WHEN {{0}} IN {vowels} THEN 'v' WHEN {{0}} IN ('N', 'Q', 'R') THEN 's' ELSE 'c' END"
    # a row of the recursion is one row of the edit matrix
    sub = f"""CASE WHEN a = b THEN 0::DOUBLE WHEN a = '?' OR b = '?' THEN {m.unknown_sub_cost}::DOUBLE ELSE coalesce({cost_map}[least(a, b) || '|' || greatest(a, b)],
      CASE {symbol.format('a')} || {symbol.format('b')} WHEN 'vv' THEN {m.vowel_vowel_default}::DOUBLE WHEN 'cc' THEN {m.consonant_consonant_default}::DOUBLE ELSE {m.cross_class_default}::DOUBLE END) END"""
    symbols = sorted({p for v in table.values() for p in v} | {"?"})
    distance = f"""alphabet AS (SELECT unnest({_lists(symbols)}) AS x),
subs AS MATERIALIZED (SELECT map(list(a || '|' || b), list({sub})) AS m FROM (SELECT p.x AS a, q.x AS b FROM alphabet p, alphabet q)),
grid AS (
  SELECT k, 0 AS i, pa, pb, ca, cb, list_reduce(list_concat([0::DOUBLE], cb), lambda acc, c: acc + c) AS unused,
    list_transform(range(0, len(pb) + 1), lambda j: CASE WHEN j = 0 THEN 0::DOUBLE ELSE list_reduce(list_concat([0::DOUBLE], cb[1:j]), lambda acc, c: acc + c) END) AS line FROM pairs
  UNION ALL
  SELECT k, i + 1, pa, pb, ca, cb, unused,
    list_reduce(list_transform(range(0, len(pb) + 1), lambda j: [CASE WHEN j = 0 THEN line[1] + ca[i + 1] ELSE least(line[j + 1] + ca[i + 1], line[j] + m[pa[i + 1] || '|' || pb[j]]) END, CASE WHEN j = 0 THEN 0::DOUBLE ELSE cb[j] END]),
      lambda acc, c: CASE WHEN len(acc) = 0 THEN [c[1]] ELSE list_append(acc, least(c[1], acc[-1] + c[2])) END, []::DOUBLE[]) AS line
  FROM grid, subs WHERE i < len(pa)),
distances AS (SELECT k, line[-1] AS raw FROM grid WHERE i = len(pa))"""
    morae = lambda c: f"len(list_filter({c}, lambda p: p IN {special}))"
    names = f"""names AS MATERIALIZED (SELECT p_name AS surface, min(p_partkey) AS entry_id, max(p_size)::DOUBLE AS weight, {phonemes_sql(kana_sql('p_name'))} AS ph FROM part GROUP BY p_name)"""
    scored = "scored AS (SELECT quality AS y, (n_chars % 101) / 100 AS score FROM labels JOIN documents USING (doc_id))"
    grams2 = "list_transform(range(1, len(q)), lambda i: q[i] || '+' || q[i + 1])"
    grams3 = "list_transform(range(1, len(q) - 1), lambda i: q[i] || '+' || q[i + 1] || '+' || q[i + 2])"
    ends, ordinary = hallucination.SEGMENT_ENDS.replace("\n", "\\n").replace("\r", "\\r"), "(" + ", ".join(f"'{x}'" for x in hallucination.ORDINARY) + ")"
    terms = "(VALUES ('the'), ('und'), ('les'), ('que'), ('ing'))"
    kinds = lambda *names: "[" + "".join(CLASSES[x] for x in names) + "]"
    n = lambda cls: f"len(regexp_extract_all(t, '{cls}'))"
    return {
        "phonemes_of_words": f"WITH {words_cte} SELECT word, array_to_string(ph, ' ') AS phonemes, CAST({morae('ph')} AS INT) AS morae FROM words",
        "indel_profile": f"WITH {words_cte}, c AS (SELECT word, {indel('ph')} AS c FROM words) SELECT word, round(list_reduce(list_concat([0::DOUBLE], c), lambda acc, v: acc + v), 6) AS total, list_min(c) AS least, list_max(c) AS most FROM c",
        "phoneme_ngrams": f"WITH {words_cte}, p AS (SELECT word, list_concat(['^'], ph, ['$']) AS q FROM words) SELECT word, array_to_string({grams2}, '|') AS grams FROM p",
        "gram_idf": f"""WITH {words_cte}, p AS (SELECT word, list_concat(['^'], ph, ['$']) AS q, len(ph) AS n FROM words WHERE len(ph) > 0 AND len(list_filter(ph, lambda x: x <> '?')) > 0),
g AS (SELECT unnest(list_distinct(CASE WHEN n >= 4 THEN list_concat({grams2}, {grams3}) ELSE {grams2} END)) AS gram FROM p)
SELECT gram, count(*) AS df, round(ln(1 + (SELECT count(*) FROM p) / (1 + count(*))), 9) AS idf FROM g GROUP BY gram""",
        "normalized_distance_pairs": f"""WITH RECURSIVE {names}, two AS (SELECT surface, ph, {indel('ph')} AS c FROM names),
pairs AS MATERIALIZED (SELECT a.surface || '~' || b.surface AS k, a.surface AS a, b.surface AS b, a.ph AS pa, b.ph AS pb, a.c AS ca, b.c AS cb FROM two a JOIN two b ON a.surface[1] = b.surface[1] AND a.surface < b.surface),
{distance} SELECT a, b, round(raw / greatest(1, len(pa), len(pb)), 6) AS nd FROM pairs JOIN distances USING (k)""",
        "bounded_distance": f"""WITH RECURSIVE {names}, two AS (SELECT surface, ph, {indel('ph')} AS c FROM names),
pairs AS MATERIALIZED (SELECT a.surface || '~' || b.surface AS k, a.surface AS a, b.surface AS b, a.ph AS pa, b.ph AS pb, a.c AS ca, b.c AS cb FROM two a JOIN two b ON a.surface[1] = b.surface[1] AND a.surface < b.surface),
{distance}, n AS (SELECT a, b, raw, greatest(1, len(pb)) AS by_term, greatest(1, (len(pa) + len(pb)) / 2) AS by_mean FROM pairs JOIN distances USING (k))
SELECT a, b, CASE WHEN raw <= 0.4::DOUBLE * by_term THEN round(raw / by_term, 6) END AS by_term, CASE WHEN raw <= 0.4::DOUBLE * by_mean THEN round(raw / by_mean, 6) END AS by_mean FROM n""",
        "topk_exhaustive": f"""WITH RECURSIVE {words_cte}, {names}, w AS (SELECT word, ph, {indel('ph')} AS c, {morae('ph')} AS m FROM words WHERE len(ph) > 0), t AS (SELECT *, {indel('ph')} AS c, {morae('ph')} AS m FROM names WHERE len(ph) > 0),
pairs AS MATERIALIZED (SELECT word || '~' || surface AS k, word, surface, entry_id, weight, w.ph AS pa, t.ph AS pb, w.c AS ca, t.c AS cb FROM w JOIN t
  ON abs(len(w.ph) - len(t.ph)) * 0.15::DOUBLE <= 0.6::DOUBLE * greatest(len(w.ph), len(t.ph)) + 1e-9::DOUBLE AND (greatest(w.m, t.m) = 0 OR abs(w.m - t.m) / greatest(w.m, t.m) <= 0.34::DOUBLE + 1e-9::DOUBLE)),
{distance}, near AS (SELECT word, surface, entry_id, weight, raw, raw / greatest(1, len(pa), len(pb)) AS nd FROM pairs JOIN distances USING (k) WHERE raw <= 0.6::DOUBLE * greatest(1, len(pa), len(pb))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY nd, weight DESC, surface, entry_id) AS rank FROM near)
SELECT word, CAST(rank AS INT) AS rank, entry_id, surface, round(raw, 6) AS raw, round(nd, 6) AS nd FROM ranked WHERE rank <= 5""",
        "glossary_merge": """WITH r AS (SELECT p_name AS surface, list({'r': p_type, 'a': p_brand} ORDER BY p_partkey) AS l, min(p_partkey) AS entry_id, first(p_brand ORDER BY p_partkey) AS category, max(p_size)::DOUBLE AS weight FROM part GROUP BY p_name),
f AS (SELECT *, l[1].r AS reading, flatten(list_transform(l, lambda x: [x.r, x.a])) AS every FROM r)
SELECT entry_id, surface, reading, array_to_string(list_filter(every, lambda x, i: x <> reading AND list_position(every, x) = i), '|') AS aliases, category, weight FROM f""",
        "glossary_subset": "SELECT p_partkey AS entry_id, p_name AS surface FROM part ORDER BY md5('seed|' || p_partkey), p_partkey LIMIT 50",
        "surface_semi_join": f"WITH {words_cte} SELECT word FROM words WHERE word IN (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM documents)",
        "surface_anti_join": f"WITH {words_cte} SELECT word FROM words WHERE word NOT IN (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM documents)",
        "cer_by_brand": "SELECT p_brand, CAST(sum(levenshtein(p_name, p_type)) AS BIGINT) AS edits, CAST(sum(length(p_name)) AS BIGINT) AS chars, round(sum(levenshtein(p_name, p_type)) / sum(length(p_name)), 9) AS cer FROM part GROUP BY p_brand",
        "term_recall": f"""WITH d AS (SELECT lang, coalesce(text, '') AS gold, replace(coalesce(text, ''), ' the ', ' teh ') AS hyp FROM documents), c AS (SELECT lang, term, (length(gold) - length(replace(gold, term, ''))) // length(term) AS g, (length(hyp) - length(replace(hyp, term, ''))) // length(term) AS h FROM d, {terms} t(term))
SELECT lang, term, CAST(sum(g) AS BIGINT) AS gold, CAST(sum(least(g, h)) AS BIGINT) AS found, round(CASE WHEN sum(g) = 0 THEN 0 ELSE sum(least(g, h)) / sum(g) END, 9) AS recall FROM c GROUP BY lang, term HAVING sum(g) > 0""",
        "token_count_estimate": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS (SELECT doc_id, length(t) AS n, {n(kinds('kanji'))} AS k, {n(kinds('hiragana', 'katakana'))} AS h, {n(kinds('latin'))} AS l, {n(kinds('digit'))} AS d FROM d)
SELECT doc_id, CAST(CASE WHEN n = 0 THEN 0 ELSE greatest(1, round_even(k + 0.75::DOUBLE * h + 0.25::DOUBLE * l + 0.5::DOUBLE * d + (n - k - h - l - d), 0)) END AS BIGINT) AS tokens FROM c""",
        "hallucination_segments": "WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[。．.\\n\\r！!？?]+'), lambda x: x <> '') AS s FROM documents) SELECT doc_id, CAST(len(s) AS BIGINT) AS segments, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS BIGINT) AS longest FROM d",
        "roc_auc": f"WITH {scored}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS k FROM scored) SELECT round((sum(k) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 9) AS auc FROM r",
        "calibration_error": f"WITH {scored}, b AS (SELECT count(*) AS n, avg(score) AS s, avg(y) AS a FROM scored GROUP BY least(floor(score * 10), 9)) SELECT round(sum(n * abs(s - a)) / sum(n), 9) AS ece FROM b",
        "threshold_sweep": f"WITH {scored}, t AS (SELECT unnest(range(0, 101)) AS i) SELECT i / 100 AS threshold, CAST(count(*) AS BIGINT) AS accepted, CAST(sum(y) AS BIGINT) AS repairs, CAST(sum(1 - y) AS BIGINT) AS damages FROM t JOIN scored ON score * 100 + 1e-9 >= i GROUP BY i",
        "heuristic_gate": "SELECT p_partkey, round(1 / (1 + exp(-(3.2::DOUBLE - 11 * (p_size / 100) + 2.4::DOUBLE * ((p_partkey % 10) / 10) + 0.35::DOUBLE * least(length(p_name), 8) - 3 * ((p_partkey % 3) / 10) - 1.4::DOUBLE * greatest(0, 2 - length(p_name)) - 2.6::DOUBLE * (p_partkey % 2)))), 9) AS probability FROM part",
        "hallucination_hits": f"""WITH phrases AS (SELECT unnest(range(0, {len(hallucination.PHRASES)})) AS place, unnest({_lists(hallucination.PHRASES)}) AS pattern),
t AS (SELECT p_partkey AS doc_id, p_name || '。' || pattern || '。' || CASE WHEN p_partkey % 3 = 0 THEN pattern || '。' ELSE '' END AS text FROM part JOIN phrases ON place = p_partkey % {len(hallucination.PHRASES)}),
r AS (SELECT *, regexp_extract_all(text, '[{ends}]+|[^{ends}]+') AS l FROM t), u AS (SELECT doc_id, text, l, unnest(l) AS run, unnest(range(1, len(l) + 1)) AS i FROM r),
h AS (SELECT doc_id, text, pattern, pattern IN {ordinary} AS weak, (length(text) - length(replace(text, pattern, ''))) // length(pattern) > 1 AS twice,
  CAST(length(array_to_string(l[1:i - 1], '')) + instr(run, pattern) - 1 AS INT) AS start FROM u JOIN phrases ON trim(run, '{hallucination.EDGE}') = pattern),
e AS (SELECT *, CAST(start + length(pattern) AS INT) AS stop, length(text) - start - length(pattern) <= 40 AS tail, trim(text) = pattern AS entire FROM h)
SELECT doc_id, start, stop, pattern, concat_ws('|', 'whole-segment', CASE WHEN twice THEN 'repeated' END, CASE WHEN tail THEN 'transcript-tail' END, CASE WHEN entire THEN 'entire-transcript' END) AS evidence,
  1 + twice::INT + 0.5::DOUBLE * tail::INT + 1.5::DOUBLE * entire::INT - 0.5::DOUBLE * weak::INT AS score FROM e WHERE NOT weak OR twice OR entire""",
        "span_enumeration": f"""WITH d AS (SELECT item_id AS doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+|[^a-z\\s]') AS w FROM benchmark), e AS (SELECT doc_id, w, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
t AS (SELECT doc_id, i, NOT regexp_matches(word, '^[a-z]') AS mark, length(word) <= 2 AS short, length(word) AS n, sum(length(word)) OVER (PARTITION BY doc_id ORDER BY i) - length(word) AS start,
  count(*) FILTER (NOT regexp_matches(word, '^[a-z]')) OVER (PARTITION BY doc_id ORDER BY i) AS marks, w FROM e)
SELECT a.doc_id, CAST(a.start AS INT) AS start, CAST(b.start + b.n AS INT) AS stop, {kana_sql("array_to_string(a.w[a.i:b.i], '')")} AS span
FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 7 AND a.marks = b.marks WHERE NOT a.mark AND NOT a.short AND NOT b.short AND b.start + b.n - a.start <= 24""",
        "edit_outcomes": "SELECT p_partkey, CASE sign(levenshtein(p_name, p_brand) - levenshtein(p_name, p_type)) WHEN -1 THEN 'repair' WHEN 1 THEN 'damage' ELSE 'neutral' END AS outcome FROM part",
    }
