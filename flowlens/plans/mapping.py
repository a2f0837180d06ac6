"""Name resolution at plan time: input column names to a feature schema. Only names are looked at, never rows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from flowlens import schemas as SC


def normalize_name(name: str) -> str:
    return re.sub(r"[._\-/\s]+", " ", name.strip().lower()).strip()


def unique_names(names: list[str]) -> list[str]:
    """Stripped header names; a repeated name gets ``.1``, ``.2`` … as data-frame readers do."""
    seen: dict[str, int] = {}
    out = []
    taken = {n.strip() for n in names}
    for name in (n.strip() for n in names):
        count = seen.get(name, 0)
        seen[name] = count + 1
        fresh = name
        while count and (fresh := f"{name}.{count}") in taken:
            count += 1
        taken.add(fresh)
        out.append(fresh)
    return out


def split_labels(columns: list[str]) -> tuple[list[str], list[str]]:
    """(feature columns, ground-truth columns), so that no target leaks into a model's input."""
    labels = [c for c in columns if c.strip().lower() in SC.LABEL_NAMES]
    return [c for c in columns if c not in labels], labels


def pick(columns: list[str], candidates: list[str]) -> str | None:
    """The input column for the first candidate that is present, as written or by normalised name."""
    by_token = {normalize_name(c): c for c in columns}
    for candidate in candidates:
        if candidate in columns:
            return candidate
        if normalize_name(candidate) in by_token:
            return by_token[normalize_name(candidate)]
    return None


def name_rules(model: str) -> list[tuple[str, int, str, str, str]]:
    """(target, priority, how, kind, key): an input column whose ``kind`` form equals ``key`` provides ``target``;
    the lowest priority wins. Kinds are the name as written, in lower case, and normalised."""
    forms = (("exact", str), ("lower", str.lower), ("token", normalize_name))
    rules = []
    for target in SC.FEATURES[model]:
        for step, ((kind, form), how) in enumerate(zip(forms, ("EXACT_MATCH", "CASE_NORMALIZED", "ALIAS_MAPPED"))):
            rules.append((target, step, how, kind, form(target)))
        for place, alias in enumerate(SC.ALIASES[model].get(target, [])):
            for step, (kind, form) in enumerate(forms):
                rules.append((target, 10 + 3 * place + step, "ALIAS_MAPPED", kind, form(alias)))
    return rules


@dataclass
class MappingPlan:
    model: str
    sources: dict[str, tuple[str, str]] = field(default_factory=dict)  # target -> (input column, how)
    derived: dict[str, list[str]] = field(default_factory=dict)        # target -> bases used
    missing: list[str] = field(default_factory=list)
    extra: list[str] = field(default_factory=list)

    @property
    def matched(self) -> int:
        return sum(how != "ALIAS_MAPPED" for _, how in self.sources.values())

    @property
    def match_percentage(self) -> float:
        return round(100.0 * (len(self.sources) + len(self.derived)) / len(SC.FEATURES[self.model]), 1)

    @property
    def status(self) -> str:
        if self.matched == len(SC.FEATURES[self.model]):
            return SC.EXACT_MATCH
        return SC.UNSUPPORTED if self.missing else SC.TRANSFORMABLE

    def report(self) -> list[tuple[str, str | None, str, str]]:
        """(target, source, transform type, status) in schema order."""
        rows = []
        for target in SC.FEATURES[self.model]:
            if target in self.sources:
                rows.append((target, *self.sources[target], "mapped"))
            elif target in self.derived:
                rows.append((target, ", ".join(self.derived[target]), "DERIVED_CALCULATION", "mapped"))
            else:
                rows.append((target, None, "MISSING", "missing"))
        return rows


def resolve(columns: list[str], model: str) -> MappingPlan:
    features, _ = split_labels(columns)
    lookup = {
        "exact": {c: c for c in features},
        "lower": {c.lower(): c for c in features},
        "token": {normalize_name(c): c for c in features},
    }
    plan = MappingPlan(model)
    for target, _priority, how, kind, key in name_rules(model):
        if target not in plan.sources and key in lookup[kind]:
            plan.sources[target] = (lookup[kind][key], how)
    for target in SC.FEATURES[model]:
        if target in plan.sources:
            continue
        bases = next(
            (b for b in SC.DERIVABLE[model].get(target, []) if all(x in plan.sources for x in b)), None
        )
        if bases is None:
            plan.missing.append(target)
        else:
            plan.derived[target] = bases
    used = {source for source, _ in plan.sources.values()}
    plan.extra = [c for c in features if c not in used]
    return plan


def choose_model(columns: list[str], requested: str | None = None) -> tuple[str, MappingPlan]:
    """The requested schema, else the first one that can be filled, else the best match."""
    if requested is not None:
        model = SC.model_of(requested)
        return model, resolve(columns, model)
    plans = {m: resolve(columns, m) for m in ("cicids", "unsw", "generalized")}
    for model, plan in plans.items():
        if not plan.missing:
            return model, plan
    best = max(plans, key=lambda m: plans[m].match_percentage)
    return best, plans[best]
