"""Fixed values of Japanese phonology and of the cost model."""

from __future__ import annotations

from functools import cache

from echolex.functions.cost_model import DEFAULT, CostModel

VOWELS = "aiueo"
SPECIALS = ("N", "Q", "R")
UNKNOWN = "?"

# Kana of each onset, in the order a i u e o; "_" where there is none.
ONSETS = [
    ("", "アイウエオ"), ("", "ァィゥェォ"), ("k", "カキクケコ"), ("g", "ガギグゲゴ"), ("s", "サ_スセソ"), ("sh", "_シ___"), ("z", "ザ_ズゼゾ"), ("j", "_ジ___"),
    ("t", "タ__テト"), ("ch", "_チ___"), ("ts", "__ツ__"), ("d", "ダ__デド"), ("j", "_ヂ___"), ("z", "__ヅ__"), ("n", "ナニヌネノ"), ("h", "ハヒ_ヘホ"), ("f", "__フ__"),
    ("b", "バビブベボ"), ("p", "パピプペポ"), ("m", "マミムメモ"), ("y", "ヤ_ユ_ヨ"), ("y", "ャ_ュ_ョ"), ("r", "ラリルレロ"), ("w", "ワ____"), ("w", "ヮ____"), ("", "_ヰ_ヱヲ"),
    ("v", "ヷヸヴヹヺ"), ("k", "ヵ____"), ("k", "ヶ____"),
]

# First kana, its onset with a small kana, and the small kana that it takes.
DIGRAPHS = [
    ("キ", "ky", "ャュョェ"), ("ギ", "gy", "ャュョェ"), ("シ", "sh", "ャュョェィ"), ("ジ", "j", "ャュョェィ"), ("チ", "ch", "ャュョェ"), ("ヂ", "j", "ャュョ"), ("ニ", "ny", "ャュョェ"),
    ("ヒ", "hy", "ャュョェ"), ("ビ", "by", "ャュョ"), ("ピ", "py", "ャュョ"), ("ミ", "my", "ャュョ"), ("リ", "ry", "ャュョェ"), ("フ", "f", "ァィェォ"), ("フ", "fy", "ュャョ"),
    ("ヴ", "v", "ァィェォ"), ("ヴ", "vy", "ュャョ"), ("ツ", "ts", "ァィェォ"), ("テ", "t", "ァィ"), ("ト", "t", "ゥ"), ("テ", "ty", "ュ"), ("デ", "d", "ィ"), ("ド", "d", "ゥ"), ("デ", "dy", "ュ"),
    ("ウ", "w", "ィェォ"), ("ウ", "y", "ャ"), ("ク", "kw", "ァィェォ"), ("グ", "gw", "ァィェォ"), ("ス", "s", "ィ"), ("ズ", "z", "ィ"), ("イ", "y", "ェ"),
]
SMALL = {"ァ": "a", "ィ": "i", "ゥ": "u", "ェ": "e", "ォ": "o", "ャ": "a", "ュ": "u", "ョ": "o"}

# Spoken names of Latin letters and digits.
LETTER_NAMES = dict(zip("abcdefghijklmnopqrstuvwxyz", "エー ビー シー ディー イー エフ ジー エイチ アイ ジェー ケー エル エム エヌ オー ピー キュー アール エス ティー ユー ブイ ダブリュー エックス ワイ ゼット".split(), strict=True))
DIGIT_NAMES = dict(zip("0123456789", "ゼロ イチ ニ サン ヨン ゴ ロク ナナ ハチ キュウ".split(), strict=True))

# Half-width kana and their full forms; voiced and half-voiced forms.
HALF_WIDTH = "ｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜｦﾝｧｨｩｪｫｬｭｮｯｰ"
FULL_WIDTH = "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワヲンァィゥェォャュョッー"
PLAIN, VOICED = "カキクケコサシスセソタチツテトハヒフヘホウ", "ガギグゲゴザジズゼゾダヂヅデドバビブベボヴ"
PLAIN_H, HALF_VOICED = "ハヒフヘホ", "パピプペポ"
LONG_MARKS = "〜~－—―–ｰ"
SKIPPED = " 　・=＝-‐"

# Costs of hearing one sound as another.
CONFUSIONS = [
    ("k", "g", 0.30), ("ky", "gy", 0.30), ("s", "z", 0.30), ("sh", "j", 0.30), ("t", "d", 0.30), ("ch", "j", 0.32),
    ("ts", "z", 0.40), ("h", "b", 0.38), ("hy", "by", 0.38), ("b", "p", 0.30), ("by", "py", 0.30), ("f", "v", 0.30),
    ("kw", "gw", 0.30), ("t", "ts", 0.40), ("d", "z", 0.40), ("s", "sh", 0.35), ("z", "j", 0.30), ("sh", "ch", 0.35),
    ("ch", "ts", 0.35), ("s", "ts", 0.40), ("t", "ch", 0.40), ("d", "j", 0.40), ("s", "h", 0.50), ("sh", "h", 0.50),
    ("sh", "hy", 0.45), ("k", "ky", 0.40), ("g", "gy", 0.40), ("n", "ny", 0.38), ("h", "hy", 0.40), ("b", "by", 0.40),
    ("p", "py", 0.40), ("m", "my", 0.40), ("r", "ry", 0.40), ("f", "fy", 0.40), ("v", "vy", 0.40), ("t", "ty", 0.40),
    ("d", "dy", 0.40), ("ty", "ch", 0.35), ("dy", "j", 0.35), ("n", "m", 0.35), ("n", "N", 0.28), ("m", "N", 0.30),
    ("ny", "N", 0.42), ("my", "N", 0.45), ("N", "u", 0.62), ("N", "o", 0.66), ("N", "i", 0.70), ("r", "d", 0.45),
    ("r", "n", 0.50), ("r", "w", 0.55), ("r", "l", 0.10), ("y", "i", 0.40), ("w", "u", 0.40), ("y", "ny", 0.45),
    ("w", "v", 0.45), ("w", "b", 0.50), ("h", "w", 0.55), ("y", "r", 0.55), ("h", "f", 0.38), ("f", "p", 0.45),
    ("f", "b", 0.50), ("h", "k", 0.55), ("v", "b", 0.35), ("f", "s", 0.50), ("t", "k", 0.60), ("k", "p", 0.65),
    ("t", "p", 0.65), ("d", "g", 0.60), ("b", "d", 0.60), ("b", "g", 0.65), ("k", "kw", 0.30), ("g", "gw", 0.30),
    ("i", "e", 0.35), ("u", "o", 0.35), ("a", "o", 0.45), ("a", "e", 0.50), ("u", "i", 0.45), ("o", "e", 0.50),
    ("a", "u", 0.55), ("a", "i", 0.55), ("i", "o", 0.60), ("e", "u", 0.50), ("Q", "t", 0.55), ("Q", "k", 0.55),
    ("Q", "s", 0.55), ("Q", "ts", 0.55), ("Q", "ch", 0.58), ("Q", "p", 0.58), ("Q", "sh", 0.58), ("R", "a", 0.20),
    ("R", "i", 0.20), ("R", "u", 0.20), ("R", "e", 0.20), ("R", "o", 0.20),
]
EPENTHESIS_U = "s sh ts z j k g t d ch b p f v".split()
EPENTHESIS_I = "ch j sh k g r t d".split()


def monographs() -> dict[str, tuple[str, ...]]:
    return {k: tuple(x for x in (onset, VOWELS[i]) if x) for onset, row in ONSETS for i, k in enumerate(row) if k != "_"}


def digraphs() -> dict[str, tuple[str, ...]]:
    return {first + small: (onset, SMALL[small]) for first, onset, smalls in DIGRAPHS for small in smalls}


@cache
def confusions() -> dict[tuple[str, str], float]:
    return {tuple(sorted((a, b))): c for a, b, c in CONFUSIONS}


def cost_model() -> list[tuple[float, str, str]]:
    """Every confusion, cheapest first."""
    return sorted((c, a, b) for (a, b), c in confusions().items())


def alphabet() -> list[str]:
    """All phonemes: onsets, vowels, the special ones and the unknown one."""
    return sorted({p for v in tokens().values() for p in v} | set(SPECIALS) | {UNKNOWN})


def canonical(phonemes: list[str], model: CostModel = DEFAULT) -> list[str]:
    """Long marks repeat the vowel before them (a leading one goes); o u becomes o o and e i becomes e e, in cascade; runs of
    one vowel become one: each as the model says."""
    out: list[str] = []
    for p in phonemes:
        if p != "R" or not model.expand_long_vowel_mark:
            out.append(p)
        elif out and out[-1] in VOWELS:
            out.append(out[-1])
    pairs = {pair for pair, on in ((("o", "u"), model.fold_ou_to_oo), (("e", "i"), model.fold_ei_to_ee)) if on}
    folded: list[str] = []
    for p in out:
        last = folded[-1] if folded else ""
        folded.append(last if (last, p) in pairs else p)
    if model.collapse_long_vowels:
        folded = [p for i, p in enumerate(folded) if not (i and p in VOWELS and folded[i - 1] == p)]
    return folded


def spoken(kana: str, model: CostModel = DEFAULT) -> list[str]:
    """Phonemes of a spoken name in kana of these tables."""
    two, one, out, i = digraphs(), monographs(), [], 0
    while i < len(kana):
        if kana[i : i + 2] in two:
            out += two[kana[i : i + 2]]
            i += 2
            continue
        out += {"ッ": ["Q"], "ン": ["N"], "ー": ["R"]}.get(kana[i]) or one[kana[i]]
        i += 1
    return canonical(out, model)


def tokens(model: CostModel = DEFAULT) -> dict[str, list[str]]:
    """Phonemes of everything that a reading may hold; what is not here is unknown."""
    out = {k: list(v) for k, v in (monographs() | digraphs()).items()} | {"ッ": ["Q"], "ン": ["N"], "ー": ["R"]} | {c: [] for c in SKIPPED}
    for c, name in LETTER_NAMES.items():
        out[c] = out[c.upper()] = spoken(name, model)
    return out | {c: spoken(name, model) for c, name in DIGIT_NAMES.items()}


def substitution(a: str, b: str, model: CostModel = DEFAULT) -> float:
    """What hearing one phoneme as the other costs."""
    if a == b:
        return 0.0
    if UNKNOWN in (a, b):
        return model.unknown_sub_cost
    va, vb, special = a in VOWELS, b in VOWELS, a in SPECIALS or b in SPECIALS
    rest = model.vowel_vowel_default if va and vb else model.consonant_consonant_default if not (va or vb or special) else model.cross_class_default
    return confusions().get(tuple(sorted((a, b))), rest)
