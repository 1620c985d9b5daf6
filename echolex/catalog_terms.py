"""Queries over large term lists, other phonetic models, alignments and intervals, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolex import catalog
from echolex.functions import distance_batch, sounds
from echolex.functions import sound_tables as S
from echolex.functions.columns import once
from echolex.functions.cost_model import DEFAULT, CostModel
from echolex.operators import edits, hallucination, lookup, rendering, term_automaton
from echolex.sources.checkpoints import written

_read = catalog._read
#: Another phonetic model: marks stay, other costs, distances by the mean length.
OTHER = CostModel(expand_long_vowel_mark=False, fold_ou_to_oo=False, collapse_long_vowels=True, vowel_vowel_default=0.42, indel_vowel=0.7, indel_Q=0.11, indel_R=0.2, indel_glide=0.33, normalize_by="mean")
#: How words are misheard: letters that change, and letters that go.
HEARD = ("etlsdn", "adrz")
TAU = 0.2


def _document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ASCII words of all documents."""
    return catalog._heard(spark, sf_dir).distinct()


def topk_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of all documents' words does each part name sound like? The index holds tens of thousands of readings."""
    # written, so that the documents are read once
    terms = written(_document_words(spark, sf_dir)).select(F.col("word").alias("entry_id"), F.col("word").alias("surface"), F.length("word").cast("double").alias("weight"), F.array(catalog.as_kana("word")).alias("readings"))
    names = _read(spark, sf_dir, "part").select("p_name").distinct()
    asked = once(names, phonemes=sounds.phonemes(catalog.as_kana("p_name"))).withColumnRenamed("p_name", "q_key")
    found = lookup.top_k(asked, lookup.readings(terms), lookup.QueryBounds(tau=TAU))
    return found.select(F.col("q_key").alias("name"), "rank", F.col("surface").alias("word"), F.round("raw", 6).alias("raw"), F.round("nd", 6).alias("nd"))


def _misheard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.words(spark, sf_dir).select("word", F.translate("word", *HEARD).alias("heard"))


def phonemes_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and their misheard forms under another model: phonemes, what they cost to insert, and how far apart they are."""
    ph = lambda c: sounds.phonemes(catalog.as_kana(c), OTHER)
    rows = _misheard(spark, sf_dir).select("word", ph("word").alias("pa"), ph("heard").alias("pb"))
    rows = rows.withColumns({"ca": sounds.indel_costs("pa", OTHER), "cb": sounds.indel_costs("pb", OTHER)})
    raw = distance_batch.phonetic_distance("pa", "pb", "ca", "cb", OTHER)
    total = F.aggregate("ca", F.lit(0.0), lambda a, c: a + c)
    return rows.select("word", F.array_join("pa", " ").alias("phonemes"), F.round(total, 6).alias("indel"), F.round(raw / sounds.normalizer("pa", "pb", OTHER.normalize_by), 6).alias("nd"))


def phonetic_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each word's phonemes become those of its misheard form, operation by operation."""
    rows = _misheard(spark, sf_dir).select("word", "heard", *(sounds.phonemes(catalog.as_kana(c)).alias(n) for c, n in (("word", "pa"), ("heard", "pb"))))
    rows = rows.select("word", "heard", distance_batch.alignment("pa", "pb", sounds.indel_costs("pa"), sounds.indel_costs("pb")).alias("ops"))
    line = F.array_join(F.transform("ops", lambda o: F.concat(o["a"], o["op"], o["b"])), " ")
    return rows.select("word", "heard", line.alias("operations"), F.round(F.aggregate("ops", F.lit(0.0), lambda s, o: s + o["cost"]), 6).alias("cost"))


LONG = "[a-z]{10,}"
#: Pieces that begin, end or go over the ends of segments, besides whole words.
PIECES = [". the", ".\n", "e. ", "\nthe ", "is a", "! ", "? w"]


def _long_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(LONG), F.lit(0))).alias("term")).distinct()
    return found.select("term", F.substring("term", 1, 1).alias("category"))


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All longer words of all documents as terms, some ten thousand: in how many texts each stands, in how many places, and how many of these
    are left where a letter is misheard."""
    docs = _read(spark, sf_dir, "documents").select(F.col("text").alias("reference"), F.replace("text", F.lit("ent"), F.lit("ant")).alias("hypothesis"))
    found = term_automaton.counts(docs, _long_words(spark, sf_dir), ["reference", "hypothesis"], [], ["term", "category"])
    return found.groupBy("category", "term").agg(F.count("*").alias("texts"), F.sum("n_0").cast("long").alias("places"), F.sum(F.least("n_0", "n_1")).cast("long").alias("kept"))


def terms_in_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the benchmark's longest words and some pieces stand in the documents, and the segment around each place, which places over
    an end of a sentence have not."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    words = _read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{10,}"), F.lit(0))).alias("term"))
    terms = words.union(spark.createDataFrame([(x,) for x in PIECES], "term string")).distinct()
    found = hallucination.containing(term_automaton.places(docs, terms, "text", ["doc_id"], ["term"]), hallucination.segments(docs))
    return found.select("doc_id", "term", "start", F.col("end").alias("stop"), F.md5("segment").alias("segment"))


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with a canned phrase as a segment of its own, within one, at both ends of one, and alone."""
    phrases = F.array(*map(F.lit, hallucination.PHRASES))
    p = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("n"), F.get(phrases, (F.col("p_partkey") % len(hallucination.PHRASES)).cast("int")).alias("p"))
    kind, stop = F.col("doc_id") % 7, F.lit("。")
    text = F.when(kind == 0, F.concat("n", stop, "p", stop)).when(kind == 1, F.concat("n", "p", "n", stop)).when(kind == 2, F.concat("p", "n", "p")).when(kind == 3, F.col("p")).when(kind == 4, F.concat("p", stop, "p", "n"))
    return p.select("doc_id", text.otherwise(F.concat("n", stop, F.repeat("n", 9), "p")).alias("text"))


def phrase_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canned phrases anywhere in the texts, by the evidence alone; of overlapping ones the best."""
    hits = hallucination.find(_embedded(spark, sf_dir), hallucination.FilterConfig(tau=0.0, least_score=0.5, require_segment=False))
    return hits.select("doc_id", "start", F.col("end").alias("stop"), "pattern", F.array_join("evidence", "|").alias("evidence"), "score")


def char_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return edits.char_damage(p.select(F.col("p_name").alias("reference"), F.lower("p_type").alias("baseline"), F.concat_ws(" ", "p_name", "p_brand").alias("corrected")))


def char_damage_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns of conversations, misheard and in part put right: for each role what the correction broke and mended."""
    text = F.coalesce("text", F.lit(""))
    wrong = F.replace(F.replace(text, F.lit("en"), F.lit("a")), F.lit(" de"), F.lit("de "))
    d = _read(spark, sf_dir, "conversations").select("role", text.alias("reference"), wrong.alias("baseline"), F.replace(F.replace(wrong, F.lit("de "), F.lit(" de")), F.lit("ti"), F.lit("it")).alias("corrected"))
    sums = d.select("role", edits.damage("reference", "baseline", "corrected").alias("d")).groupBy("role")
    return sums.agg(*(F.sum(f"d.{x}").cast("long").alias(x) for x in ("correct_before", "broken", "fixed")))


def span_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What replacing two characters of a text that begins as each part's name does, does to it."""
    p = _read(spark, sf_dir, "part")
    rows = p.select("p_partkey", F.col("p_name").alias("reference"), F.concat(F.substring("p_name", 1, 3), "p_type").alias("baseline"), F.lit(1).alias("start"), F.lit(3).alias("end"), F.when(F.col("p_partkey") % 3 == 0, F.substring("p_name", 2, 2)).when(F.col("p_partkey") % 3 == 1, F.substring("p_brand", 1, 2)).otherwise(F.lit("zz")).alias("replacement"))
    return edits.classify_span_edits(rows).select("p_partkey", "outcome")


def rendered_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations with two edits each, one of which goes over the other's place in every third, marked as HTML."""
    turns = _read(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long = turns.where(F.length("text") >= 12)
    one = long.select("doc_id", F.lit(1).alias("start"), F.lit(4).alias("end"), F.lit("<&'>").alias("replacement"))
    at = F.when(F.col("doc_id.turn") % 3 == 0, 3).otherwise(6)
    two = long.select("doc_id", at.alias("start"), (at + 2).alias("end"), F.lit(None).cast("string").alias("replacement"))
    rows = rendering.diff(turns, one.union(two))
    return rows.select("doc_id.conv_id", "doc_id.turn", F.length("html").cast("long").alias("chars"), F.md5("html").alias("digest"), "shown")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (topk_terms, phonemes_by_model, phonetic_alignment, term_counts, terms_in_segments, phrase_evidence, char_damage, char_damage_of_turns, span_outcomes, rendered_diffs)}


def _swaps(model: CostModel) -> str:
    """Costs of hearing each symbol as each, in one list by place: (number of a - 1) * symbols + number of b."""
    symbols = S.alphabet()
    return "[" + ", ".join(f"{S.substitution(a, b, model)!r}::DOUBLE" for a in symbols for b in symbols) + "]"


def _numbers(ph: str) -> str:
    """Phonemes as numbers from 1, the unknown one for others."""
    symbols = S.alphabet()
    return f"list_transform({ph}, lambda p: coalesce(list_position({catalog._lists(symbols)}, p), {symbols.index(S.UNKNOWN) + 1}))"


def oracle_sql() -> dict[str, str]:
    words = "raw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark)"
    kana, morae = catalog.kana_sql, lambda c: f"len(list_filter({c}, lambda p: p IN ('a', 'i', 'u', 'e', 'o', 'N', 'Q', 'R')))"
    n = len(S.alphabet())
    misheard = f"heard AS (SELECT word, translate(word, '{HEARD[0]}', '{HEARD[1]}') AS heard FROM raw)"

    def pairs(model: CostModel) -> str:
        both = f"two AS MATERIALIZED (SELECT word, heard, {catalog.phonemes_sql(kana('word'), model)} AS pa, {catalog.phonemes_sql(kana('heard'), model)} AS pb FROM heard)"
        return f"{words}, {misheard}, {both}, pairs AS MATERIALIZED (SELECT word AS k, word, heard, pa, pb, {catalog.indel_sql('pa', model)} AS ca, {catalog.indel_sql('pb', model)} AS cb, {_numbers('pa')} AS na, {_numbers('pb')} AS nb FROM two), {grid(model)}"

    def grid(model: CostModel) -> str:
        """Rows of the matrices one after another: a row of the recursion is a row of a matrix."""
        return f"""swaps AS MATERIALIZED (SELECT {_swaps(model)} AS w),
grid AS (
  SELECT k, 0 AS i, list_transform(range(0, len(nb) + 1), lambda j: CASE WHEN j = 0 THEN 0::DOUBLE ELSE list_reduce(list_concat([0::DOUBLE], cb[1:j]), lambda acc, c: acc + c) END) AS line FROM pairs
  UNION ALL
  SELECT k, i + 1, list_reduce(list_transform(range(0, len(nb) + 1), lambda j: [CASE WHEN j = 0 THEN line[1] + ca[i + 1] ELSE least(line[j + 1] + ca[i + 1], line[j] + w[(na[i + 1] - 1) * {n} + nb[j]]) END, CASE WHEN j = 0 THEN 0::DOUBLE ELSE cb[j] END]),
    lambda acc, c: CASE WHEN len(acc) = 0 THEN [c[1]] ELSE list_append(acc, least(c[1], acc[-1] + c[2])) END, []::DOUBLE[])
  FROM grid JOIN pairs USING (k), swaps WHERE i < len(na))"""

    pieces = "[" + ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in PIECES) + "]"
    ends = hallucination.SEGMENT_ENDS.replace("\n", "\\n").replace("\r", "\\r")
    ends_plain, ordinary = "。．.！!？?", "(" + ", ".join(f"'{x}'" for x in hallucination.ORDINARY) + ")"
    # one pair at a time, given up (a line of -1) once a whole row is over the bound
    most = f"{TAU}::DOUBLE * greatest(len(na), len(nb)) + 1e-6"
    row = "list_reduce(list_transform(range(0, len(cb) + 1), lambda j: CASE WHEN j = 0 THEN [acc[1] + e[1], 0::DOUBLE] ELSE [least(acc[j + 1] + e[1], acc[j] + e[j + 1]), cb[j]] END), lambda l, c: CASE WHEN len(l) = 0 THEN [c[1]] ELSE list_append(l, least(c[1], l[-1] + c[2])) END, []::DOUBLE[])"
    costs = f"list_transform(range(1, len(na) + 1), lambda i: list_prepend(ca[i], list_transform(nb, lambda s: {_swaps(DEFAULT)}[(na[i] - 1) * {n} + s])))"
    first = "list_reduce(list_transform(list_concat([0::DOUBLE], cb), lambda v: [v]), lambda l, v: CASE WHEN len(l) = 0 THEN v ELSE list_append(l, l[-1] + v[1]) END, []::DOUBLE[])"
    one_by_one = f"list_reduce({costs}, lambda acc, e: CASE WHEN acc[1] < 0 THEN acc WHEN list_min(acc) > {most} THEN [-1::DOUBLE] ELSE {row} END, {first})[-1]"
    def diagonals(rows: str) -> str:
        """Of texts a and b by k: recursive steps (k, i, j, out), out the pairs that the alignment puts together."""
        return f"""texts AS MATERIALIZED ({rows}),
grid AS (
  SELECT k, 0 AS i, range(0, length(b) + 1) AS line FROM texts
  UNION ALL
  SELECT k, i + 1, list_reduce(list_transform(range(0, length(b) + 1), lambda j: [CASE WHEN j = 0 THEN line[1] + 1 ELSE least(line[j + 1] + 1, line[j] + CASE WHEN a[i + 1] = b[j] THEN 0 ELSE 1 END) END]), lambda l, c: CASE WHEN len(l) = 0 THEN c ELSE list_append(l, least(c[1], l[-1] + 1)) END, []::BIGINT[])
  FROM grid JOIN texts USING (k) WHERE i < length(a)),
whole AS MATERIALIZED (SELECT k, list(line ORDER BY i) AS d FROM grid GROUP BY k),
steps AS (
  SELECT k, length(a) AS i, length(b) AS j, []::STRUCT(i BIGINT, j BIGINT, same BOOLEAN)[] AS out FROM texts
  UNION ALL
  SELECT k, CASE WHEN op < 2 THEN i - 1 ELSE i END, CASE WHEN op <> 1 THEN j - 1 ELSE j END, CASE WHEN op = 0 THEN list_prepend({{'i': i - 1, 'j': j - 1, 'same': a[i] = b[j]}}, out) ELSE out END FROM (
    SELECT s.k, i, j, out, a, b, CASE WHEN i > 0 AND j > 0 AND d[i + 1][j + 1] = d[i][j] + CASE WHEN a[i] = b[j] THEN 0 ELSE 1 END THEN 0 WHEN i > 0 AND (j = 0 OR d[i + 1][j + 1] = d[i][j + 1] + 1) THEN 1 ELSE 2 END AS op
    FROM steps s JOIN texts t ON s.k = t.k JOIN whole w ON s.k = w.k WHERE i > 0 OR j > 0)),
pairs AS (SELECT k, out FROM steps WHERE i = 0 AND j = 0)"""

    def escaped(x: str) -> str:
        for character, name in rendering.ESCAPES:
            x = f"replace({x}, '{character.replace(chr(39), chr(39) * 2)}', '{name}')"
        return x

    quoted = "'<&''>'"
    same = "list_transform(list_filter({0}, lambda p: p.same), lambda p: p.i)"
    third = "CASE p_partkey % 3 WHEN 0 THEN substr(p_name, 2, 2) WHEN 1 THEN substr(p_brand, 1, 2) ELSE 'zz' END"
    return {
        "char_damage": f"""WITH RECURSIVE {diagonals("SELECT p_partkey || '|b' AS k, p_name AS a, lower(p_type) AS b FROM part UNION ALL SELECT p_partkey || '|c', p_name, p_name || ' ' || p_brand FROM part")},
o AS (SELECT x.k, {same.format('x.out')} AS b, {same.format('y.out')} AS c FROM pairs x JOIN pairs y ON x.k[-1] = 'b' AND y.k = x.k[:-2] || 'c'),
s AS (SELECT sum(len(b)) AS n, sum(len(list_filter(b, lambda v: NOT list_contains(c, v)))) AS x, sum(len(list_filter(c, lambda v: NOT list_contains(b, v)))) AS f FROM o)
SELECT CAST(n AS BIGINT) AS correct_before, CAST(x AS BIGINT) AS broken, CAST(f AS BIGINT) AS fixed, CASE WHEN n = 0 THEN 0 ELSE x / n END AS damage_rate FROM s""",
        "rendered_diffs": f"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS x FROM conversations),
p AS (SELECT *, length(x) >= 12 AS cut, turn % 3 = 0 AS over FROM t),
h AS (SELECT *, CASE WHEN NOT cut THEN {escaped('x')} WHEN over THEN {escaped('x[1:1]')} || '<del>' || {escaped('x[2:4]')} || '</del><ins>' || {escaped(quoted)} || '</ins>' || {escaped('x[5:]')}
  ELSE {escaped('x[1:1]')} || '<del>' || {escaped('x[2:4]')} || '</del><ins>' || {escaped(quoted)} || '</ins>' || {escaped('x[5:6]')} || '<del>' || {escaped('x[7:8]')} || '</del>' || {escaped('x[9:]')} END AS y FROM p),
r AS (SELECT *, replace(y, chr(10), '<br>') AS html FROM h)
SELECT conv_id, turn, length(html) AS chars, md5(html) AS digest, CAST(CASE WHEN NOT cut THEN 0 WHEN over THEN 1 ELSE 2 END AS BIGINT) AS shown FROM r""",
        "span_outcomes": f"""WITH RECURSIVE {diagonals("SELECT p_partkey AS k, substr(p_name, 1, 3) || p_type AS a, p_name AS b FROM part")},
r AS (SELECT p_partkey, p_name AS ref, substr(p_name, 1, 3) || p_type AS base, {third} AS new, list_transform(list_filter(out, lambda p: p.i >= 1 AND p.i < 3), lambda p: p.j) AS js FROM part JOIN pairs ON k = p_partkey),
q AS (SELECT *, base[2:3] AS old, CASE WHEN len(js) > 0 THEN ref[list_min(js) + 1:list_max(js) + 1] END AS part, base[1:1] || new || base[4:] AS after FROM r),
t AS (SELECT *, abs(length(part) - length(old)) <= greatest(1, length(old) // 2) AS trusted FROM q)
SELECT p_partkey, CASE WHEN new = old THEN 'no-op' WHEN trusted AND old = part THEN 'damage' WHEN trusted AND new = part THEN 'repair' ELSE CASE sign(levenshtein(ref, after) - levenshtein(ref, base)) WHEN -1 THEN 'repair' WHEN 1 THEN 'damage' ELSE 'neutral' END END AS outcome FROM t""",
        "topk_terms": f"""WITH names AS MATERIALIZED (SELECT p_name, ph, {_numbers('ph')} AS num, {catalog.indel_sql('ph')} AS c, {morae('ph')} AS m FROM (SELECT p_name, {catalog.phonemes_sql(kana('p_name'))} AS ph FROM (SELECT DISTINCT p_name FROM part)) WHERE len(ph) > 0),
terms AS MATERIALIZED (SELECT word, ph, {_numbers('ph')} AS num, {catalog.indel_sql('ph')} AS c, {morae('ph')} AS m FROM (SELECT word, {catalog.phonemes_sql(kana('word'))} AS ph FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)) WHERE len(ph) > 0 AND len(list_filter(ph, lambda x: x <> '?')) > 0),
pairs AS (SELECT p_name, word, a.num AS na, b.num AS nb, a.c AS ca, b.c AS cb FROM names a JOIN terms b
  ON abs(len(a.num) - len(b.num)) * 0.15::DOUBLE <= {TAU}::DOUBLE * greatest(len(a.num), len(b.num)) + 1e-9::DOUBLE AND (a.m = 0 OR b.m = 0 OR abs(a.m - b.m) / greatest(a.m, b.m) <= 0.34::DOUBLE + 1e-9::DOUBLE)),
measured AS (SELECT p_name, word, {one_by_one} AS raw, greatest(1, len(na), len(nb)) AS longer FROM pairs),
near AS (SELECT p_name, word, raw, raw / longer AS nd FROM measured WHERE raw >= 0 AND raw <= {TAU}::DOUBLE * longer),
ranked AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY nd, length(word) DESC, word) AS rank FROM near)
SELECT p_name AS name, CAST(rank AS INT) AS rank, word, round(raw, 6) AS raw, round(nd, 6) AS nd FROM ranked WHERE rank <= 5""",
        "term_counts": f"""WITH terms AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{LONG}')) AS term FROM documents),
d AS (SELECT text AS r, replace(text, 'ent', 'ant') AS h FROM documents WHERE text IS NOT NULL),
c AS (SELECT term, (length(r) - length(replace(r, term, ''))) // length(term) AS n, (length(h) - length(replace(h, term, ''))) // length(term) AS m FROM d JOIN terms ON contains(r, term))
SELECT term[1] AS category, term, count(*) AS texts, CAST(sum(n) AS BIGINT) AS places, CAST(sum(least(n, m)) AS BIGINT) AS kept FROM c GROUP BY term""",
        "terms_in_segments": f"""WITH terms AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{{10,}}')) AS term FROM benchmark UNION SELECT unnest({pieces})),
s AS (SELECT doc_id, term, string_split(text, term) AS l FROM documents JOIN terms ON contains(text, term)),
e AS (SELECT doc_id, term, unnest(l[:len(l) - 1]) AS x, unnest(range(1, len(l))) AS i FROM s),
p AS (SELECT doc_id, term, sum(length(x) + length(term)) OVER (PARTITION BY doc_id, term ORDER BY i) AS stop FROM e),
r AS (SELECT doc_id, regexp_extract_all(text, '[{ends}]+|[^{ends}]+') AS l FROM documents), u AS (SELECT doc_id, unnest(l) AS run, unnest(range(1, len(l) + 1)) AS i FROM r),
g AS (SELECT doc_id, run, sum(length(run)) OVER (PARTITION BY doc_id ORDER BY i) AS s_end FROM u)
SELECT p.doc_id, term, CAST(stop - length(term) AS INT) AS start, CAST(stop AS INT) AS stop, md5(run) AS segment FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND s_end - length(run) <= stop - length(term) AND stop <= s_end AND NOT regexp_matches(run, '^[{ends}]')""",
        "phrase_evidence": f"""WITH ph AS (SELECT unnest(range(0, {len(hallucination.PHRASES)})) AS place, unnest({catalog._lists(hallucination.PHRASES)}) AS pattern),
n AS (SELECT p_partkey AS doc_id, p_name AS n, pattern AS p FROM part JOIN ph ON place = p_partkey % {len(hallucination.PHRASES)}),
t AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN n || '。' || p || '。' WHEN 1 THEN n || p || n || '。' WHEN 2 THEN p || n || p WHEN 3 THEN p WHEN 4 THEN p || '。' || p || n ELSE n || '。' || repeat(n, 9) || p END AS text FROM n),
s AS (SELECT doc_id, text, place, pattern, string_split(text, pattern) AS l FROM t JOIN ph ON contains(text, pattern)), e AS (SELECT *, unnest(l[:len(l) - 1]) AS x, unnest(range(1, len(l))) AS i FROM s),
o AS (SELECT doc_id, text, place, pattern, len(l) > 2 AS twice, CAST(sum(length(x) + length(pattern)) OVER (PARTITION BY doc_id, pattern ORDER BY i) AS INT) AS stop FROM e),
w AS (SELECT *, CAST(stop - length(pattern) AS INT) AS start, length(text) - stop <= 40 AS tail, trim(text) = pattern AS entire, pattern IN {ordinary} AS weak,
  (stop = length(text) OR contains('{ends_plain}', text[stop + 1])) AND (stop = length(pattern) OR contains('{ends_plain}', text[stop - length(pattern)])) AS whole FROM o),
h AS (SELECT *, whole::INT + twice::INT + 0.5::DOUBLE * tail::INT + 1.5::DOUBLE * entire::INT - 0.5::DOUBLE * weak::INT AS score FROM w WHERE NOT weak OR whole::INT + twice::INT + entire::INT >= 2),
k AS (SELECT * FROM h WHERE score >= 0.5::DOUBLE)
SELECT doc_id, start, stop, pattern, concat_ws('|', CASE WHEN whole THEN 'whole-segment' END, CASE WHEN twice THEN 'repeated' END, CASE WHEN tail THEN 'transcript-tail' END, CASE WHEN entire THEN 'entire-transcript' END) AS evidence, score
FROM k WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.doc_id = k.doc_id AND b.start < k.stop AND k.start < b.stop AND (b.score, b.stop - b.start, -b.start) > (k.score, k.stop - k.start, -k.start))""",
        "phonemes_by_model": f"""WITH RECURSIVE {pairs(OTHER)}
SELECT word, array_to_string(pa, ' ') AS phonemes, round(list_reduce(list_concat([0::DOUBLE], ca), lambda acc, v: acc + v), 6) AS indel, round(line[-1] / greatest(1, (len(pa) + len(pb)) / 2), 6) AS nd FROM pairs JOIN grid USING (k) WHERE i = len(na)""",
        "phonetic_alignment": f"""WITH RECURSIVE {pairs(DEFAULT)}, whole AS MATERIALIZED (SELECT k, list(line ORDER BY i) AS d FROM grid GROUP BY k),
steps AS (
  SELECT k, len(na) AS i, len(nb) AS j, []::VARCHAR[] AS ops FROM pairs
  UNION ALL
  SELECT k, CASE WHEN op IN ('=', '~', '-') THEN i - 1 ELSE i END, CASE WHEN op IN ('=', '~', '+') THEN j - 1 ELSE j END, list_prepend(CASE WHEN op = '+' THEN '' ELSE pa[i] END || op || CASE WHEN op = '-' THEN '' ELSE pb[j] END, ops) FROM (
    SELECT s.k, i, j, ops, pa, pb, CASE WHEN i > 0 AND j > 0 AND d[i + 1][j + 1] = d[i][j] + w[(na[i] - 1) * {n} + nb[j]] THEN CASE WHEN pa[i] = pb[j] THEN '=' ELSE '~' END WHEN i > 0 AND (j = 0 OR d[i + 1][j + 1] = d[i][j + 1] + ca[i]) THEN '-' ELSE '+' END AS op
    FROM steps s JOIN pairs p ON s.k = p.k JOIN whole h ON s.k = h.k, swaps WHERE i > 0 OR j > 0))
SELECT word, heard, array_to_string(ops, ' ') AS operations, round(d[-1][-1], 6) AS cost FROM steps JOIN pairs USING (k) JOIN whole USING (k) WHERE i = 0 AND j = 0""",
    }
