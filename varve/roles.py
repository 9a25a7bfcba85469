"""Column roles and analysis settings, as frozen values that the operators take explicitly."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Roles:
    """Logical column -> physical column."""

    id: str = "id"
    timepoint: str = "yr"
    site: str = "site"
    sex: str = "sex"
    age: str = "age"
    target: str = "target"
    group: str = "grp"
    family: str = "family"
    qc: str = "qc"

    @property
    def keys(self) -> list[str]:
        return [self.id, self.timepoint]


@dataclass(frozen=True)
class Question:
    """What a research question changes: its group column and how it is derived."""

    name: str
    group: str
    required: tuple[str, ...]
    stratify: bool = True


# The research questions a run may name, with their group columns and the metadata that must be complete.
QUESTIONS = {
    "anxiety": Question("anxiety", "anx_group", ("age", "t_score", "scanner_model", "research_group")),
    "psychosis": Question("psychosis", "psych_group", ("age", "t_score", "scanner_model", "research_group")),
    "comorbidity": Question("comorbidity", "comorbid_group", ("age", "t_score", "scanner_model", "research_group")),
    "regression": Question("regression", "anx_group", ("age", "t_score", "scanner_model"), stratify=False),
}


@dataclass(frozen=True)
class Settings:
    """Settings of one run; `adapt` specialises them to a question."""

    roles: Roles = field(default_factory=Roles)
    # Study visits in order, first is the baseline.
    visits: tuple[tuple[str, str], ...] = (
        ("baseline", "baseline_year_1_arm_1"),
        ("year2", "2_year_follow_up_y_arm_1"),
        ("year3", "3_year_follow_up_y_arm_1"),
        ("year4", "4_year_follow_up_y_arm_1"),
    )
    qc_max: float = 62
    max_null_rate: float = 0.3
    required: tuple[str, ...] = ()
    families: tuple[str, ...] = ()
    prefixes: tuple[tuple[str, tuple[str, ...]], ...] = ()
    split: tuple[float, float, float] = (0.8, 0.1, 0.1)
    stratify: bool = True
    seed: int = 42
    folds: int = 5

    @property
    def baseline(self):
        return self.visits[0][1]


def adapt(settings: Settings, question: str) -> Settings:
    """Specialise settings to a named research question; an unknown name is an error."""
    if question not in QUESTIONS:
        raise ValueError(f"unknown question {question!r}; expected one of {sorted(QUESTIONS)}")
    chosen = QUESTIONS[question]
    return replace(
        settings,
        roles=replace(settings.roles, group=chosen.group),
        required=chosen.required,
        stratify=chosen.stratify,
    )


def file_columns(kind: str, metadata: list[str], derived: list[str], mapped: list[str]) -> list[str] | None:
    """Columns to read from a configured file: the deduplicated list for metadata, all (None) for imaging."""
    if kind == "imaging":
        return None
    if kind != "metadata":
        raise ValueError(f"file kind {kind!r} is not configured")
    return list(dict.fromkeys([*metadata, *derived, *mapped]))


def prefixed(columns: list[str], prefixes) -> list[str]:
    """Columns starting with any of the prefixes, in table order."""
    return [c for c in columns if c.startswith(tuple(prefixes))]


def present(columns: list[str], wanted) -> list[str]:
    """Wanted columns that exist, in the wanted order."""
    have = set(columns)
    return [c for c in wanted if c in have]


# A side is an l or r at the end of a column's name, or that letter and an h; marks of diffusion and thickness measures.
_SIDE = re.compile(r"(?P<stem>.*)(?P<side>[lr])(?P<kind>h?)", re.S)
MARKS = {"dtifa": "_FA", "dtimd": "_MD", "thick": "_thick"}


def bilateral_pairs(features: list[str]) -> tuple[list[tuple[str, str, str]], list[str]]:
    """Columns of the same stem on both sides, as (name, left, right), by first appearance; and the columns without a partner."""
    sides: dict[tuple[str, str], dict[str, str]] = {}
    for column in features:
        if m := _SIDE.fullmatch(column):
            sides.setdefault((m["stem"], m["kind"]), {})[m["side"]] = column
    pairs = [(pair_name(stem), both["l"], both["r"]) for (stem, _), both in sides.items() if len(both) == 2]
    paired = {column for _, left, right in pairs for column in (left, right)}
    return pairs, [column for column in features if column not in paired]


def pair_name(stem: str) -> str:
    """Short display name of a pair: the stem's last word and the mark of its measure; a stem in aa is the accumbens."""
    if stem.endswith("aa"):
        return "accumbens"
    return stem.rstrip("_").rpartition("_")[2] + next((mark for measure, mark in MARKS.items() if measure in stem), "")


def feature_names(mode: str, count: int, features=(), pairs=()) -> list[str]:
    """Names of a model's input columns after the feature transform."""
    if mode == "pca":
        return [f"PC{i + 1}" for i in range(count)]
    ai = sorted(f"{n}_AI" for n, _, _ in pairs)
    total = sorted(f"{n}_total" for n, _, _ in pairs)
    chosen = {"raw": list(features), "asymmetry": ai, "total": total, "ai_total": ai + total}[mode]
    return chosen[:count]
