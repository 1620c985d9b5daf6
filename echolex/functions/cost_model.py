"""The phonetic model's settings as data: they travel with a plan, to expressions and to Arrow kernels alike."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class CostModel:
    """Which passes a sequence of phonemes goes through, and what hearing one sound as another, adding or losing one costs.

    Names and values are those of settings files (JSON objects); see ``from_dict``."""

    # passes
    expand_long_vowel_mark: bool = True  # else the mark stays, as R
    fold_ou_to_oo: bool = True
    fold_ei_to_ee: bool = True
    collapse_long_vowels: bool = False
    # substitutions that the table of confusions does not have
    vowel_vowel_default: float = 0.60
    consonant_consonant_default: float = 1.00
    cross_class_default: float = 1.10
    unknown_sub_cost: float = 0.95
    # insertions and deletions
    indel_consonant: float = 1.00
    indel_vowel: float = 0.85
    indel_Q: float = 0.25
    indel_N: float = 0.40
    indel_R: float = 0.15
    indel_long_vowel: float = 0.15
    indel_glide: float = 0.50
    indel_epenthetic: float = 0.50
    indel_unknown: float = 0.95
    # what a distance is divided by: max, term or mean
    normalize_by: str = "max"

    @property
    def least_indel(self) -> float:
        return min(getattr(self, f.name) for f in fields(self) if f.name.startswith("indel_"))

    def to_dict(self) -> dict[str, object]:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict[str, object]) -> CostModel:
        """Names that are not known are left out; those that are missing have their defaults."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: kinds[k](v) for k, v in values.items() if k in kinds})


DEFAULT = CostModel()
