"""Mappings from source columns to contract fields: model, static checks, suggestion, alignment, coverage. All of it is metadata on the driver."""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Callable
from dataclasses import dataclass, replace
from difflib import SequenceMatcher

from ..functions.dates import spark_format
from ..functions.text import java_pattern
from .contract import Contract, Field, canonical_json

# The closed catalogue of operations, and failure policies.
OPERATIONS = ("trim", "null_if", "uppercase", "lowercase", "title_case", "regex_replace", "parse_date", "parse_numeric", "normalize_phone", "normalize_email", "map_values", "default", "coalesce", "concatenate", "split", "generate_deterministic_id")
POLICIES = ("error", "warning_set_null", "warning_keep_original", "use_default")
NEEDED = {"null_if": ("values",), "regex_replace": ("pattern", "replacement"), "map_values": ("mapping",), "default": ("value",), "split": ("delimiter",), "generate_deterministic_id": ("input_fields",)}
# Words that abbreviations in headers stand for.
ABBREVIATIONS = {"mbr": "member", "mem": "member", "no": "number", "num": "number", "eff": "effective", "term": "termination", "sub": "subscriber", "rel": "relationship", "dt": "date"}
# Header names of each field.
ALIASES = {
    "member_id": ["member id", "member number", "member no", "mbr id", "patient id", "person id", "employee id"],
    "first_name": ["first name", "first", "fname", "given name"],
    "last_name": ["last name", "last", "lname", "surname", "family name"],
    "date_of_birth": ["dob", "date of birth", "birth date", "birthdate", "member dob", "patient birthdate"],
    "gender": ["gender", "sex"],
    "email": ["email", "email address", "member email"],
    "phone": ["phone", "phone number", "mobile", "cell"],
    "plan_id": ["plan id", "plan code", "benefit plan", "product code"],
    "plan_name": ["plan", "plan name", "benefit name", "product name"],
    "plan_type": ["plan type", "product type", "network type"],
    "carrier_name": ["carrier", "carrier name", "payer", "payer name"],
    "coverage_start_date": ["effective date", "eff date", "start date", "coverage start date", "eligibility start date"],
    "coverage_end_date": ["term date", "termination date", "end date", "coverage end date", "eligibility end date"],
    "coverage_status": ["status", "coverage status", "eligibility status", "enrollment status"],
    "relationship_to_subscriber": ["relationship", "relation", "relationship to subscriber", "dependent relationship"],
    "subscriber_id": ["subscriber id", "subscriber number", "primary member id", "employee id"],
}
# Headers that say too little.
VAGUE = ("id", "date", "status", "type", "code")
VAGUE_PHRASES = ("employee id", "subscriber id", "start date", "end date")
# Points that a column's profile gives a field, by the field's type or kind. The first line whose conditions all hold counts; a pair is the least and greatest value.
EVIDENCE = {
    "date": [(30, {"date_parse_rate": (0.85, 1)}), (20, {"date_parse_rate": (0.5, 1)}), (10, {"date_parse_rate": (0.15, 1)}), (-10, {})],
    "email": [(30, {"email_pattern_rate": (0.8, 1)}), (15, {"email_pattern_rate": (0.3, 1)}), (-10, {})],
    "phone": [(30, {"phone_pattern_rate": (0.8, 1)}), (15, {"phone_pattern_rate": (0.3, 1)}), (-10, {})],
    "enum": [(30, {"knows_field": {True}}), (15, {"inferred_type": {"enum"}}), (-10, {})],
    "member_identifier": [(30, {"null_rate": (0, 0.05), "unique_rate": (0.85, 1)}), (20, {"unique_rate": (0.5, 1)}), (-10, {"inferred_type": {"enum"}}), (10, {})],
    "subscriber_identifier": [(25, {"null_rate": (0, 0.2), "unique_rate": (0.35, 1)}), (15, {"unique_rate": (0.15, 1)}), (5, {})],
    "plan_identifier": [(30, {"code_rate": (0.6, 1), "unique_rate": (0, 0.4)}), (20, {"inferred_type": {"identifier", "enum"}, "unique_rate": (0, 0.5)}), (5, {})],
    "text": [(-10, {"inferred_type": {"date", "email", "phone", "numeric"}}), (20, {"null_rate": (0, 0.1)}), (10, {})],
}
# States of a suggestion from a score on, alignments from points on, and the flag of each alignment that needs a look.
BANDS = ((85, "strong_suggestion"), (70, "suggested"), (50, "weak_suggestion"), (0, "unmapped"))
ALIGNMENTS = ((20, "aligned"), (0, "weak"), (-100, "mismatch"))
ALIGNMENT_FLAGS = {"weak": "weak_type_alignment", "mismatch": "target_type_mismatch"}


class ConfigurationError(ValueError):
    pass


@dataclass(frozen=True)
class Step:
    operation: str
    parameters: dict


@dataclass(frozen=True)
class Mapping:
    table: str
    field: str
    columns: tuple[str, ...] = ()
    steps: tuple[Step, ...] = ()
    policy: str = "error"
    default: str | None = None
    approved: bool = True
    steps_approved: bool = True
    confidence: int = 0
    flags: tuple[str, ...] = ()
    status: str = ""
    alignment: str = ""
    needs_review: bool = False

    @property
    def source(self) -> str:
        return "; ".join(self.columns)


def column_key(name: str | None) -> str:
    """A header as lower-case words with abbreviations written out."""
    text = (name or "").strip().lower()
    text = re.sub(r"[_\-/]", " ", text)
    text = text.translate({ord(c): None for c in string.punctuation if c != "_"})
    return " ".join(ABBREVIATIONS.get(w, w) for w in text.split())


def steps_of(raw) -> tuple[Step, ...]:
    """Steps from JSON values: [{"operation": .., "parameters": {..}}]."""
    out = []
    for s in raw or []:
        op = str(s.get("operation") or "")
        if op not in OPERATIONS:
            raise ConfigurationError(f"Unsupported transformation operation: {op}.")
        out.append(Step(op, dict(s.get("parameters") or {})))
    return tuple(out)


def check(m: Mapping, target: Field | None, columns: list[str]) -> list[str]:
    """Everything wrong with a mapping's pipeline, before any plan is made."""
    out = [f"Unknown source column: {c}." for c in m.columns if c not in columns]
    if m.policy not in POLICIES:
        out.append(f"Unsupported failure policy: {m.policy}.")
    if m.policy == "use_default" and m.default is None:
        out.append("use_default needs a default.")
    if target is not None and target.required and m.policy == "warning_set_null":
        out.append("A required field can't be set to null on failure.")
    for s in m.steps:
        if s.operation not in OPERATIONS:
            out.append(f"Unsupported transformation operation: {s.operation}.")
            continue
        out += [f"{s.operation} needs {p}." for p in NEEDED.get(s.operation, ()) if p not in s.parameters and not (p == "mapping" and s.parameters.get("crosswalk"))]
        out += [f"Unknown source column: {c}." for c in s.parameters.get("source_columns") or [] if c not in columns]
        try:
            if s.operation == "regex_replace" and "pattern" in s.parameters:
                re.compile(str(s.parameters["pattern"]))
                java_pattern(str(s.parameters["pattern"]))
            for f in s.parameters.get("accepted_formats") or [] if s.operation == "parse_date" else []:
                spark_format(str(f))
        except (re.error, ValueError) as e:
            out.append(f"{s.operation}: {e}")
        if s.operation == "generate_deterministic_id" and target is not None and not target.generated:
            out.append("generate_deterministic_id is for generated fields only.")
    return out


def recommended(target: Field) -> tuple[Step, ...]:
    """Steps to start with, by type."""
    by = {"text": ["trim"], "identifier": ["trim"], "date": ["parse_date"], "numeric": ["parse_numeric"], "email": ["trim", "normalize_email"], "phone": ["normalize_phone"], "enum": ["trim"]}
    names = [] if target.generated else by.get(target.data_type, [])
    return tuple(Step(n, {"accepted_formats": []} if n == "parse_date" else {}) for n in names)


# ------------------------------------------------------------------------------------------------- suggestion


def names_of(target: Field, aliases: dict[str, list[str]] | None = None) -> list[str]:
    return [column_key(a) for a in [target.name.replace("_", " "), *(aliases or ALIASES).get(target.name, []), *target.aliases]]


def name_score(key: str, names: list[str]) -> int:
    """70 for an alias, 60 for a close spelling, 45 and 25 for shared words."""
    if key in names:
        return 70
    if max(SequenceMatcher(None, key, n).ratio() for n in names) >= 0.84:
        return 60
    mine = set(key.split())
    shared = max((len(mine & set(n.split())) / len(set(n.split())) for n in names if mine and n), default=0.0)
    return 45 if shared >= 0.65 else 25 if shared >= 0.35 else 0


def code_rate(values: list[str]) -> float:
    """Share of values that look like codes: letters and digits in 24 signs at most, or nothing small in 16; dashes, underscores and spaces aren't counted."""

    def most(v: str) -> int:
        mixed = any(map(str.isdigit, v)) and any(map(str.isalpha, v))
        return 24 if mixed else 16 if v == v.upper() else -1

    return sum(sum(c not in "-_ " for c in v.strip()) <= most(v.strip()) for v in values) / len(values) if values else 0.0


def _from(x: float, bands: tuple[tuple[float, str], ...]) -> str:
    return next(name for least, name in bands if x >= least)


def value_score(p: dict, target: Field) -> int:
    """-10 to 30: how well a column's profile fits the field's kind of values; 0 for kinds without evidence."""
    facts = p | {"code_rate": code_rate(p["samples"]), "knows_field": target.name in (p.get("known_enum_matches") or {})}
    holds = lambda name, want: facts[name] in want if isinstance(want, set) else want[0] <= facts[name] <= want[1]
    typed = target.data_type in ("date", "email", "phone", "enum") or target.kind not in EVIDENCE
    lines = EVIDENCE.get(target.data_type if typed else target.kind, [(0, {})])
    return next(points for points, conditions in lines if all(holds(*c) for c in conditions.items()))


def vagueness(key: str) -> tuple[int, tuple[str, ...]]:
    """Points off, and the flag, of a header that says too little."""
    vague = key in VAGUE or key in VAGUE_PHRASES
    return (-20, ("ambiguous_" + key.replace(" ", "_"),)) if vague else (0, ())


def suggest(profiles: list[dict], contract: Contract, aliases: dict[str, list[str]] | None = None) -> list[Mapping]:
    """The best column for each field that isn't generated, with its band and flags. Below 50 a field stays unmapped; below 85 or flagged it needs review.

    A profile has column_name, normalized_name, inferred_type, null_rate, unique_rate, the three pattern rates, known_enum_matches and samples.
    """
    out = []
    for t in contract.fields:
        if t.generated:
            continue
        names, best = names_of(t, aliases), None
        for p in profiles:
            points, (penalty, flags) = value_score(p, t), vagueness(p["normalized_name"])
            score = max(0, min(100, name_score(p["normalized_name"], names) + points + penalty))
            if best is None or score > best[0]:  # ties keep the order of the source
                best = score, p["column_name"], flags, _from(points, ALIGNMENTS)
        m = Mapping(t.table, t.name, (), recommended(t), "error" if t.required else "warning_set_null", approved=False, steps_approved=False, status="unmapped", alignment="not_mapped")
        if best is None or best[0] < 50:
            out.append(replace(m, flags=("required_unmapped",) * t.required, needs_review=t.required))
            continue
        score, column, flags, fit = best
        flags = tuple(sorted({*flags, *([ALIGNMENT_FLAGS[fit]] if fit in ALIGNMENT_FLAGS else [])}))
        out.append(replace(m, columns=(column,), confidence=score, flags=flags, status=_from(score, BANDS), alignment=fit, needs_review=score < 85 or bool(flags)))
    return _conflicts(out)


def _conflicts(found: list[Mapping]) -> list[Mapping]:
    """Where several logical fields want one column, ten points less and a flag for all but the best; equal scores keep their order."""
    out = list(found)
    for column in {m.columns for m in found if m.columns}:
        rivals = sorted((k for k, m in enumerate(found) if m.columns == column), key=lambda k: -found[k].confidence)
        if len({found[k].field for k in rivals}) > 1:
            for k in rivals[1:]:
                score = max(0, out[k].confidence - 10)
                out[k] = replace(out[k], confidence=score, status=_from(score, BANDS), flags=tuple(sorted({*out[k].flags, "multiple_candidate_targets"})), needs_review=True)
    return out


def align(found: list[Mapping], profiles: list[dict], contract: Contract) -> list[Mapping]:
    """Adds alignment: aligned, weak, mismatch, not_mapped or unknown_source; all but the first and the fourth are flagged for review."""
    by, fields = {p["column_name"]: p for p in profiles}, {(f.table, f.name): f for f in contract.fields}

    def of(m: Mapping) -> str:
        if not m.columns:
            return "not_mapped"
        if m.columns[0] not in by:
            return "unknown_source"
        return _from(value_score(by[m.columns[0]], fields[m.table, m.field]), ALIGNMENTS)

    flags = ALIGNMENT_FLAGS | {"unknown_source": "unknown_source_column"}
    out = [(m, of(m)) for m in found]
    return [replace(m, alignment=a, flags=tuple(dict.fromkeys([*m.flags, flags[a]])), needs_review=True) if a in flags else replace(m, alignment=a) for m, a in out]


def blocking(found: list[Mapping]) -> list[Mapping]:
    """Approved mappings whose alignment forbids validation."""
    return [m for m in found if m.approved and m.alignment in ("mismatch", "unknown_source")]


def source_coverage(profiles: list[dict], found: list[Mapping]) -> list[dict]:
    """Each source column's use: approved_mapped, suggested_mapped or unused; every input of a field counts."""

    def inputs(m: Mapping) -> set[str]:
        return {*m.columns, *(c for s in m.steps for c in s.parameters.get("source_columns") or [])}

    approved = {c for m in found if m.approved for c in inputs(m)}
    named = {c for m in found for c in inputs(m)}
    out = []
    for p in profiles:
        c = p["column_name"]
        status = "approved_mapped" if c in approved else "suggested_mapped" if c in named else "unused"
        review = status == "unused" and p["inferred_type"] in ("identifier", "date", "email", "phone", "enum")
        out.append({"column_name": c, "status": status, "inferred_type": p["inferred_type"], "needs_review": review})
    return out


#: Columns of the audit of mapping decisions and of source columns.
DECISION = ["target_table", "target_field", "target_data_type", "target_validation_kind", "source_inferred_type", "type_alignment", "source_column", "source_columns", "confidence", "mapping_mode", "approved", "needs_review", "reason", "transformation_rules_json", "failure_policy", "transformation_approved"]
SOURCE_COLUMN = ["source_column", "normalized_name", "inferred_type", "null_rate", "unique_rate", "coverage_status", "mapped_targets", "approved_targets", "review_recommendation"]


def decisions(found: list[Mapping], contract: Contract, profiles: list[dict], mode: str = "rules") -> list[tuple]:
    """A row of DECISION for each mapping."""
    fields, kinds = {(f.table, f.name): f for f in contract.fields}, {p["column_name"]: p["inferred_type"] for p in profiles}
    out = []
    for m in found:
        f = fields[m.table, m.field]
        first = m.columns[0] if m.columns else None
        out.append((m.table, m.field, f.data_type, f.kind, kinds.get(first), m.alignment, first, "; ".join(m.columns), m.confidence, mode, m.approved, m.needs_review, ", ".join(m.flags), canonical_json(as_json(m)["transformation_steps"]), m.policy, m.steps_approved))
    return out


def source_columns(profiles: list[dict], found: list[Mapping]) -> list[tuple]:
    """A row of SOURCE_COLUMN for each column of the source."""
    uses = {c["column_name"]: c for c in source_coverage(profiles, found)}
    out = []
    for p in profiles:
        c = p["column_name"]
        named = [m for m in found if c in m.columns]
        targets = ["; ".join(f"{m.table}.{m.field}" for m in ms) for ms in (named, [m for m in named if m.approved])]
        advice = "Review: it looks like it holds data of a target field." if uses[c]["needs_review"] else ""
        out.append((c, p["normalized_name"], p["inferred_type"], float(p["null_rate"]), float(p["unique_rate"]), uses[c]["status"], *targets, advice))
    return out


# -------------------------------------------------------------------------------------------------- gates


def required_gaps(found: list[Mapping], contract: Contract) -> list[Field]:
    """Required fields, generated ones aside, without an approved mapping."""
    have = {(m.table, m.field) for m in found if m.approved and (m.columns or m.steps)}
    return [f for f in contract.fields if f.required and not f.generated and (f.table, f.name) not in have]


def unapproved_steps(found: list[Mapping]) -> list[Mapping]:
    return [m for m in found if m.approved and m.steps and not m.steps_approved]


def can_publish(status: str, signoff: str, reviewer: str, gaps: list, mapping_moved: bool) -> bool:
    return status != "FAIL" and signoff != "needs_customer_correction" and not gaps and not mapping_moved and (status == "PASS" or bool(reviewer.strip()))


# --------------------------------------------------------------------------------------- templates and drafts


def as_json(m: Mapping) -> dict:
    return {"target_table": m.table, "target_field": m.field, "source_columns": list(m.columns), "transformation_steps": [{"operation": s.operation, "parameters": s.parameters} for s in m.steps], "failure_policy": m.policy, "failure_default": m.default, "transformation_approved": m.steps_approved}


def from_json(raw: dict) -> Mapping:
    """A stored mapping; older files with a single source column and no steps load too. Approval is never taken over."""
    columns = raw.get("source_columns") or ([raw["source_column"]] if raw.get("source_column") else [])
    return Mapping(raw["target_table"], raw["target_field"], tuple(columns), steps_of(raw.get("transformation_steps")), raw.get("failure_policy") or "error", raw.get("failure_default"), approved=False, steps_approved=False)


def checksum(found: list[Mapping]) -> str:
    rows = sorted((as_json(m) for m in found), key=lambda r: (r["target_table"], r["target_field"]))
    return hashlib.sha256(canonical_json(rows).encode()).hexdigest()


def draft_payload(profiles: list[dict], contract: Contract) -> dict:
    """What a language model is told: the contract's fields and each column's profile with 5 samples at most."""
    fields = [{"table": f.table, "field": f.name, "required": f.required, "data_type": f.data_type, "allowed_values": list(f.allowed), "description": f.description} for f in contract.fields if not f.generated]
    keys = ("column_name", "normalized_name", "inferred_type", "null_rate", "unique_rate", "date_parse_rate", "email_pattern_rate", "phone_pattern_rate")
    return {"target_fields": fields, "source_columns": [{k: p[k] for k in keys} | {"samples": p["samples"][:5]} for p in profiles], "operations": list(OPERATIONS)}


def response_schema(profiles: list[dict], contract: Contract) -> dict:
    """A strict JSON schema of the answer: known targets, columns and operations only."""
    text = lambda values: {"type": "string", "enum": values}
    step = {"type": "object", "properties": {"operation": text(list(OPERATIONS)), "parameters": {"type": "object"}}, "required": ["operation", "parameters"], "additionalProperties": False}
    item = {
        "target_table": text(sorted({f.table for f in contract.fields})), "target_field": text(sorted({f.name for f in contract.fields if not f.generated})),
        "source_columns": {"type": "array", "items": text([p["column_name"] for p in profiles])}, "confidence": {"type": "integer", "minimum": 0, "maximum": 100}, "transformation_steps": {"type": "array", "items": step},
    }
    rows = {"type": "array", "items": {"type": "object", "properties": item, "required": list(item), "additionalProperties": False}}
    return {"type": "object", "properties": {"mappings": rows}, "required": ["mappings"], "additionalProperties": False}


def read_draft(response: dict, profiles: list[dict], contract: Contract) -> list[Mapping]:
    """Mappings of a model's answer. Unknown targets or columns, repeats, confidences outside 0 to 100 and unknown operations raise."""
    fields, columns, out = {(f.table, f.name): f for f in contract.fields if not f.generated}, {p["column_name"] for p in profiles}, {}
    for r in response.get("mappings") or []:
        key = r.get("target_table"), r.get("target_field")
        if key not in fields:
            raise ConfigurationError(f"Unknown target {key[0]}.{key[1]}.")
        if key in out:
            raise ConfigurationError(f"{key[0]}.{key[1]} is mapped twice.")
        given = [c for c in r.get("source_columns") or [] if c]
        if bad := [c for c in given if c not in columns]:
            raise ConfigurationError(f"Unknown source columns {bad}.")
        confidence = r.get("confidence")
        if not isinstance(confidence, int) or isinstance(confidence, bool) or not 0 <= confidence <= 100:
            raise ConfigurationError("confidence must be a whole number from 0 to 100.")
        out[key] = Mapping(*key, tuple(given), steps_of(r.get("transformation_steps")), r.get("failure_policy") or ("error" if fields[key].required else "warning_set_null"), approved=False, confidence=confidence)
    return list(out.values())


def draft_mappings(profiles: list[dict], contract: Contract, ask: Callable[[dict], dict]) -> list[Mapping]:
    """A model's mappings over the rule-based ones, which stay where it gave none. ask sends the payload; no provider is built in."""
    base = {(m.table, m.field): m for m in suggest(profiles, contract)}
    return list((base | {(m.table, m.field): m for m in read_draft(ask(draft_payload(profiles, contract)), profiles, contract)}).values())
