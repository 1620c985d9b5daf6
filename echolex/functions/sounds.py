"""Phonology as Column expressions: kana folding, phonemes, morae, costs, weighted distance.

All functions take columns (or names) and stay inside the JVM. Null in gives null out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from echolex.functions import sound_tables as S
from echolex.functions.cost_model import DEFAULT, CostModel

_HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
_KATAKANA = "".join(chr(ord(c) + 0x60) for c in _HIRAGANA)


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold_half_width(text: Column | str) -> Column:
    """Half-width kana to full width; a (half-)voicing mark joins the kana before it, or vanishes after any other."""
    full = F.translate(_col(text), S.HALF_WIDTH, S.FULL_WIDTH)
    marked = full
    for plain, voiced, mark in ((S.PLAIN, S.VOICED, "ﾞ"), (S.PLAIN_H, S.HALF_VOICED, "ﾟ")):
        for a, b in zip(plain, voiced, strict=True):
            marked = F.replace(marked, F.lit(a + mark), F.lit(b))
    return F.when(full.rlike("[ﾞﾟ]"), F.regexp_replace(marked, r"(?<=[\s\S])[ﾞﾟ]", "")).otherwise(full)


def to_katakana(text: Column | str) -> Column:
    return F.translate(fold_half_width(text), _HIRAGANA + S.LONG_MARKS, _KATAKANA + "ー" * len(S.LONG_MARKS))


def to_hiragana(text: Column | str) -> Column:
    return F.translate(_col(text), _KATAKANA, _HIRAGANA)


def canonicalize(phonemes: Column | str, collapse: bool | None = None, model: CostModel = DEFAULT) -> Column:
    """Long marks repeat the vowel before them, then o u becomes o o and e i becomes e e (in cascade), then, with ``collapse``,
    runs of one vowel become one; ``model`` says which of these passes there are."""
    vowels, out = list(S.VOWELS), _col(phonemes)
    none = F.array().cast("array<string>")
    last = lambda a: F.when(F.size(a) > 0, F.element_at(a, -1)).otherwise("")
    if model.expand_long_vowel_mark:
        out = F.aggregate(out, none, lambda a, p: F.when(p != "R", F.concat(a, F.array(p))).when(last(a).isin(vowels), F.concat(a, F.array(last(a)))).otherwise(a))
    pairs = [pair for pair, on in (("ou", model.fold_ou_to_oo), ("ei", model.fold_ei_to_ee)) if on]
    if pairs:
        fold = lambda a, p: reduce(Column.__or__, ((last(a) == x) & (p == y) for x, y in pairs))
        out = F.aggregate(out, none, lambda a, p: F.concat(a, F.array(F.when(fold(a, p), last(a)).otherwise(p))))
    if model.collapse_long_vowels if collapse is None else collapse:
        whole = out
        out = F.filter(whole, lambda p, i: ~(p.isin(vowels) & (i > 0) & (F.get(whole, i - 1) == p)))
    return out


def _spoken(model: CostModel) -> Callable[[Column], Column]:
    """The phonemes, joined by blanks, of a kana, a digraph or another character; null of what is unknown. Single characters
    of the two common ranges are looked up by place."""
    table = {k: " ".join(v) for k, v in S.tokens(model).items()}
    ranges = [(0x30A1, 0x30FF), (0x00, 0x7F)]
    quoted = lambda x: "null" if x is None else f"'{x}'"
    placed = [F.expr("array(" + ", ".join(quoted(table.get(chr(c))) for c in range(a, b + 1)) + ")") for a, b in ranges]
    as_map = lambda rows: F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in rows.items()) + ")")
    digraphs = as_map({k: v for k, v in table.items() if len(k) == 2})
    rest = as_map({k: v for k, v in table.items() if len(k) == 1 and not any(a <= ord(k) <= b for a, b in ranges)})

    def one(token: Column) -> Column:
        code, out = F.ascii(token), F.when(F.length(token) == 2, F.try_element_at(digraphs, token))
        for (a, b), values in zip(ranges, placed, strict=True):
            out = out.when(code.between(a, b), F.get(values, code - a))
        return out.otherwise(F.try_element_at(rest, token))

    return one


def phonemes(kana: Column | str, model: CostModel = DEFAULT) -> Column:
    """The phonemes of a reading; digraphs before single kana, Latin letters and digits by their spoken names, else ``?``."""
    parts, one = F.regexp_extract_all(to_katakana(kana), F.lit("(?:" + "|".join(S.digraphs()) + r"|[\s\S])"), F.lit(0)), _spoken(model)
    spoken = F.array_join(F.filter(F.transform(parts, lambda t: F.coalesce(one(t), F.lit(S.UNKNOWN))), lambda p: p != ""), " ")
    return canonicalize(F.filter(F.split(spoken, " "), lambda p: p != ""), model=model)


def heard(kana: Column | str, model: CostModel = DEFAULT) -> Column:
    """An array of one struct: phonemes, morae and indel of a reading; the phonemes are made once a row."""
    one = lambda p: F.struct(p.alias("phonemes"), mora_count(p).alias("morae"), indel_costs(p, model).alias("indel"))
    return F.transform(F.array(phonemes(kana, model)), one)


def mora_count(phonemes: Column | str) -> Column:
    return F.size(F.filter(_col(phonemes), lambda p: p.isin(*S.VOWELS, *S.SPECIALS)))


def indel_costs(phonemes: Column | str, model: CostModel = DEFAULT) -> Column:
    """Cost of inserting or deleting each phoneme, given its neighbours."""
    ph = _col(phonemes)

    def cost(p: Column, i: Column) -> Column:
        before, after = F.coalesce(F.get(ph, i - 1), F.lit("")), F.coalesce(F.get(ph, i + 1), F.lit(""))
        thin = ((p == "u") & before.isin(S.EPENTHESIS_U)) | ((p == "i") & before.isin(S.EPENTHESIS_I))
        vowel = F.when((before == p) | (after == p), model.indel_long_vowel).when(thin, model.indel_epenthetic).otherwise(model.indel_vowel)
        own = F.when(p == S.UNKNOWN, model.indel_unknown).when(p == "Q", model.indel_Q).when(p == "N", model.indel_N).when(p == "R", model.indel_R)
        return own.when(p.isin(*S.VOWELS), vowel).when(p.isin("y", "w"), model.indel_glide).otherwise(model.indel_consonant)

    return F.transform(ph, cost)


def substitution_cost(a: Column, b: Column, model: CostModel = DEFAULT) -> Column:
    table = F.expr("map(" + ", ".join(f"'{p}|{q}', {c}D" for (p, q), c in S.confusions().items()) + ")")
    hit = F.try_element_at(table, F.concat_ws("|", F.least(a, b), F.greatest(a, b)))
    va, vb = a.isin(*S.VOWELS), b.isin(*S.VOWELS)
    plain = ~va & ~vb & ~a.isin(*S.SPECIALS) & ~b.isin(*S.SPECIALS)
    rest = F.when(va & vb, model.vowel_vowel_default).when(plain, model.consonant_consonant_default).otherwise(model.cross_class_default)
    return F.when(a == b, 0.0).when((a == S.UNKNOWN) | (b == S.UNKNOWN), model.unknown_sub_cost).otherwise(F.coalesce(hit, rest))


def phonetic_distance(a: Column | str, b: Column | str, indel_a: Column | str | None = None, indel_b: Column | str | None = None, model: CostModel = DEFAULT) -> Column:
    """Weighted edit distance by a fold over rows; pass materialised ``indel_costs`` columns where there are some."""
    a, b = _col(a), _col(b)
    ca = indel_costs(a, model) if indel_a is None else _col(indel_a)
    cb = indel_costs(b, model) if indel_b is None else _col(indel_b)
    places = lambda x: F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1)).otherwise(F.array().cast("array<int>"))
    start = F.aggregate(cb, F.array(F.lit(0.0)), lambda row, c: F.concat(row, F.array(F.element_at(row, -1) + c)))

    def step(row: Column, i: Column) -> Column:
        cell = lambda new, j: F.least(F.get(row, j + 1) + F.get(ca, i), F.element_at(new, -1) + F.get(cb, j), F.get(row, j) + substitution_cost(F.get(a, i), F.get(b, j), model))
        return F.aggregate(places(b), F.array(F.get(row, F.lit(0)) + F.get(ca, i)), lambda new, j: F.concat(new, F.array(cell(new, j))))

    return F.aggregate(places(a), start, step, lambda row: F.element_at(row, -1))


def normalizer(a: Column | str, b: Column | str, by: str = "max") -> Column:
    """What a distance is divided by: the longer length (``max``), the second one (``term``) or their mean, 1 at least."""
    na, nb = F.size(_col(a)), F.size(_col(b))
    if by not in ("max", "term", "mean"):
        raise ValueError(f"no normaliser {by}")
    return F.greatest(F.lit(1.0), {"max": F.greatest(na, nb), "term": nb, "mean": (na + nb) / 2}[by].cast("double"))


def normalized_distance(a: Column | str, b: Column | str, by: str | None = None, model: CostModel = DEFAULT) -> Column:
    return phonetic_distance(a, b, model=model) / normalizer(a, b, by or model.normalize_by)


def bounded_normalized_distance(a: Column | str, b: Column | str, most: Column | float, by: str | None = None, model: CostModel = DEFAULT) -> Column:
    """The normalised distance where it is at most ``most``, else null."""
    raw, norm = phonetic_distance(a, b, model=model), normalizer(a, b, by or model.normalize_by)
    return F.when(raw <= F.lit(most) * norm, raw / norm)


def phoneme_ngrams(phonemes: Column | str, n: int = 2) -> Column:
    """Runs of n over the sequence between ``^`` and ``$``; if that is shorter, all of it as one."""
    padded = F.concat(F.array(F.lit("^")), _col(phonemes), F.array(F.lit("$")))
    runs = F.transform(F.sequence(F.lit(0), F.size(padded) - n), lambda i: F.array_join(F.slice(padded, i + 1, n), "\u001f"))
    return F.when(F.size(padded) < n, F.array(F.array_join(padded, ""))).otherwise(runs)
