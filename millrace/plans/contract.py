"""Target contracts: versioned, checksummed descriptions of the tables an import may fill."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

# The closed vocabularies of contracts.
DATA_TYPES = ("text", "identifier", "enum", "date", "numeric", "email", "phone", "boolean")
STRATEGIES = ("deterministic_business_key",)
STATUSES = ("draft", "published", "retired")
SEVERITIES = ("error", "warning")
RULES = (
    "allowed_values", "boolean", "coverage_end_date", "coverage_start_date", "coverage_status", "date_of_birth", "email", "generated_identifier", "gender", "member_identifier", "not_future", "numeric_range",
    "organization_name", "person_name", "phone", "plan_identifier", "plan_name", "plan_type", "relationship_to_subscriber", "required", "subscriber_identifier",
)
NAME = re.compile(r"^[a-z][a-z0-9_]*$")
SEMVER = re.compile(r"^\d+\.\d+\.\d+$")
SPARK_TYPES = {"date": T.DateType(), "numeric": T.DoubleType(), "boolean": T.BooleanType()}
POLICY = {"max_reject_rate": 0.10, "max_reject_rate_severity": "warning", "require_zero_orphans": True, "require_exact_row_accounting": True}


class ContractError(ValueError):
    """All that is wrong with a contract, one message a line."""


@dataclass(frozen=True)
class Field:
    table: str
    name: str
    data_type: str
    kind: str
    required: bool = False
    nullable: bool = True
    description: str = ""
    allowed: tuple[str, ...] = ()
    generated: bool = False
    strategy: str = ""
    inputs: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    rules: tuple[dict, ...] = ()


@dataclass(frozen=True)
class Table:
    name: str
    fields: tuple[Field, ...]
    primary_key: tuple[str, ...]
    business_key: tuple[str, ...]
    foreign_keys: tuple[tuple[str, str, str], ...] = ()  # (field, table, field)


@dataclass(frozen=True)
class Contract:
    key: str
    version: str
    tables: tuple[Table, ...]
    name: str = ""
    domain: str = ""
    policy: dict = field(default_factory=lambda: dict(POLICY))
    presets: tuple[str, ...] = ()
    status: str = "draft"

    @property
    def fields(self) -> list[Field]:
        return [f for t in self.tables for f in t.fields]

    @property
    def by_name(self) -> dict[str, Field]:
        """Logical fields: the first table that has a name defines it."""
        out: dict[str, Field] = {}
        for f in self.fields:
            out.setdefault(f.name, f)
        return out

    def table(self, name: str) -> Table:
        return next(t for t in self.tables if t.name == name)

    def struct(self, name: str) -> T.StructType:
        return T.StructType([T.StructField(f.name, SPARK_TYPES.get(f.data_type, T.StringType()), not f.required, {"kind": f.kind}) for f in self.table(name).fields])

    @property
    def checksum(self) -> str:
        return hashlib.sha256(canonical_json(definition(self)).encode()).hexdigest()


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def definition(c: Contract) -> dict:
    """The contract as JSON values; load() reads it back."""
    return {
        "key": c.key, "version": c.version, "name": c.name, "domain": c.domain, "reconciliation_policy": c.policy, "presets": list(c.presets),
        "tables": [
            {
                "name": t.name, "primary_key": list(t.primary_key), "business_key": list(t.business_key),
                "foreign_keys": [{"field": a, "table": b, "references": d} for a, b, d in t.foreign_keys],
                "fields": [
                    {"field": f.name, "data_type": f.data_type, "validation_kind": f.kind, "required": f.required, "nullable": f.nullable, "description": f.description, "allowed_values": list(f.allowed),
                     "generated": f.generated, "generation_strategy": f.strategy, "input_fields": list(f.inputs), "aliases": list(f.aliases), "validation_rules": list(f.rules)}
                    for f in t.fields
                ],
            }
            for t in c.tables
        ],
    }


class _Faults(list):
    def need(self, ok, message: str) -> bool:
        if not ok:
            self.append(message)
        return bool(ok)

    def kind(self, value, kind: type, at: str):
        """The value, or an empty one of its kind and a fault."""
        if value is None or isinstance(value, kind):
            return value or kind()
        self.append(f"{at} must be {'a list' if kind is list else 'an object'}.")
        return kind()

    def name(self, value, at: str) -> str:
        text = str(value or "").strip()
        self.need(NAME.match(text), f"{at} must be a lower-case identifier.")
        return text


def _rules(raw: dict, at: str, faults: _Faults) -> tuple[dict, ...]:
    given = raw.get("validation_rules")
    if given is None:  # one kind of old stands for one error rule
        kind = str(raw.get("validation_kind") or "").strip()
        given = [{"kind": kind}] if kind else []
    out = []
    for k, r in enumerate(faults.kind(given, list, f"{at} validation_rules")):
        here = f"{at} rule {k}"
        r = faults.kind(r, dict, here)
        rule = {"kind": str(r.get("kind") or "").strip(), "severity": str(r.get("severity") or "error").strip().lower(), "parameters": faults.kind(r.get("parameters"), dict, f"{here} parameters")}
        faults.need(rule["kind"] in RULES, f"{here} has an unknown kind {rule['kind']!r}.")
        faults.need(rule["severity"] in SEVERITIES, f"{here} has an unknown severity {rule['severity']!r}.")
        bounds = [rule["parameters"].get(b) for b in ("minimum", "maximum")]
        if faults.need(all(b is None or isinstance(b, (int, float)) and not isinstance(b, bool) for b in bounds), f"{here} minimum and maximum must be numbers."):
            faults.need(None in bounds or bounds[0] <= bounds[1], f"{here} has a minimum above its maximum.")
        out.append(rule)
    return tuple(out)


def _load_field(f: dict, table: str, at: str, faults: _Faults) -> Field:
    name = faults.name(f.get("field") or f.get("name"), f"{at} name")
    at = f"{table}.{name}"
    kind, generated, strategy = str(f.get("data_type") or f.get("type") or "").strip().lower(), bool(f.get("generated")), str(f.get("generation_strategy") or "").strip()
    required = bool(f.get("required"))
    nullable = bool(f.get("nullable", not required))
    strategy = strategy or (STRATEGIES[0] if generated else "")
    lists = {k: tuple(str(v) for v in faults.kind(f.get(k), list, f"{at} {k}")) for k in ("allowed_values", "input_fields", "aliases")}
    rules = _rules(f, at, faults)
    shown = str(f.get("validation_kind") or "").strip() or (rules[0]["kind"] if rules else "")
    faults.need(kind in DATA_TYPES, f"{at} has an unknown data type {kind!r}.")
    faults.need(kind != "enum" or lists["allowed_values"], f"{at} is an enum without allowed values.")
    faults.need(required != nullable, f"{at} must be either required or nullable.")
    faults.need(not strategy or strategy in STRATEGIES, f"{at} has an unknown generation strategy {strategy!r}.")
    faults.need(generated or not strategy, f"{at} has a generation strategy but isn't generated.")
    faults.need(not shown or shown in RULES, f"{at} has an unknown validation kind {shown!r}.")
    return Field(table, name, kind, shown, required, nullable, str(f.get("description") or "").strip(), lists["allowed_values"], generated, strategy, lists["input_fields"], lists["aliases"], rules)


def load(raw: dict) -> Contract:
    """A contract from JSON values. Raises ContractError with every fault found.

    Also takes contract_key for key, name for field, type for data_type, and references_table and references_field of foreign keys.
    """
    if not isinstance(raw, dict):
        raise ContractError("A contract is an object.")
    faults = _Faults()
    key = faults.name(raw.get("key") or raw.get("contract_key"), "key")
    version, title, domain = (str(raw.get(k) or "").strip() for k in ("version", "name", "domain"))
    faults.need(SEMVER.match(version), "version must be like 1.0.0.")
    faults.need(title, "name is required.")
    faults.need(domain, "domain is required.")
    tables: list[Table] = []
    given = faults.kind(raw.get("tables"), list, "tables")
    faults.need(given, "tables must not be empty.")
    for k, t in enumerate(given):
        t = faults.kind(t, dict, f"table {k}")
        at = faults.name(t.get("name"), f"table {k} name")
        faults.need(at not in [x.name for x in tables], f"table {at} occurs twice.")
        fields: list[Field] = []
        for n, f in enumerate(faults.kind(t.get("fields"), list, f"table {at} fields")):
            found = _load_field(faults.kind(f, dict, f"{at} field {n}"), at, f"{at} field {n}", faults)
            faults.need(found.name not in [x.name for x in fields], f"{at}.{found.name} occurs twice.")
            fields.append(found)
        faults.need(fields, f"table {at} has no fields.")
        primary = tuple(str(x).strip() for x in faults.kind(t.get("primary_key"), list, f"table {at} primary_key"))
        business = tuple(str(x).strip() for x in faults.kind(t.get("business_key"), list, f"table {at} business_key")) or primary
        faults.need(primary, f"table {at} has no primary key.")
        foreign = []
        for n, fk in enumerate(faults.kind(t.get("foreign_keys"), list, f"table {at} foreign_keys")):
            fk = faults.kind(fk, dict, f"table {at} foreign key {n}")
            foreign.append(tuple(str(fk.get(a) or fk.get(b) or "").strip() for a, b in (("field", "field"), ("table", "references_table"), ("references", "references_field"))))
        tables.append(Table(at, tuple(fields), primary, business, tuple(foreign)))
    _references(tables, faults)
    policy = POLICY | faults.kind(raw.get("reconciliation_policy"), dict, "reconciliation_policy")
    try:
        policy["max_reject_rate"] = float(policy["max_reject_rate"])
    except (TypeError, ValueError):
        policy["max_reject_rate"] = -1.0
    faults.need(0 <= policy["max_reject_rate"] <= 1, "max_reject_rate must be between 0 and 1.")
    policy["max_reject_rate_severity"] = str(policy["max_reject_rate_severity"] or "warning").strip().lower()
    faults.need(policy["max_reject_rate_severity"] in SEVERITIES, "max_reject_rate_severity must be error or warning.")
    presets = tuple(str(p) for p in faults.kind(raw.get("presets"), list, "presets"))
    for p in presets:
        faults.need(p in PRESETS, f"the rule preset {p!r} is unknown.")
    if faults:
        raise ContractError("\n".join(faults))
    return Contract(key, version, tuple(tables), title, domain, policy, presets)


def _references(tables: list[Table], faults: _Faults) -> None:
    """Keys, foreign keys and inputs of generated fields name fields that are there."""
    have = {t.name: {f.name for f in t.fields} for t in tables}
    anywhere = set().union(*have.values()) if have else set()
    for t in tables:
        for k in dict.fromkeys((*t.primary_key, *t.business_key)):
            faults.need(k in have[t.name], f"table {t.name} has a key on the unknown field {k!r}.")
        for a, b, d in t.foreign_keys:
            faults.need(a in have[t.name], f"table {t.name} has a foreign key on the unknown field {a!r}.")
            if faults.need(b in have, f"table {t.name} refers to the unknown table {b!r}."):
                faults.need(d in have[b], f"table {t.name} refers to the unknown field {b}.{d}.")
        for f in t.fields:
            for i in f.inputs:
                faults.need(i in anywhere, f"{t.name}.{f.name} is made of the unknown field {i!r}.")


def _field(table: str, name: str, data_type: str, kind: str, required: bool = False, allowed: str = "", **more) -> Field:
    return Field(table, name, data_type, kind, required, not required, allowed=tuple(allowed.split()), rules=({"kind": kind, "severity": "error", "parameters": {}},), **more)


def eligibility() -> Contract:
    """The built-in contract."""
    # Tables, fields, types and keys of the eligibility contract.
    m, p, c = "members", "plans", "member_coverage"
    members = (
        _field(m, "member_id", "identifier", "member_identifier", True),
        _field(m, "first_name", "text", "person_name", True),
        _field(m, "last_name", "text", "person_name", True),
        _field(m, "date_of_birth", "date", "date_of_birth", True),
        _field(m, "gender", "enum", "gender", allowed="male female other unknown"),
        _field(m, "email", "email", "email"),
        _field(m, "phone", "phone", "phone"),
    )
    plans = (
        _field(p, "plan_id", "identifier", "plan_identifier", True),
        _field(p, "plan_name", "text", "plan_name", True),
        _field(p, "plan_type", "enum", "plan_type", allowed="PPO HMO EPO HDHP POS"),
        _field(p, "carrier_name", "text", "organization_name"),
    )
    coverage = (
        _field(c, "coverage_id", "identifier", "generated_identifier", True, generated=True, strategy="deterministic_business_key", inputs=("member_id", "plan_id", "coverage_start_date")),
        _field(c, "member_id", "identifier", "member_identifier", True),
        _field(c, "plan_id", "identifier", "plan_identifier", True),
        _field(c, "coverage_start_date", "date", "coverage_start_date", True),
        _field(c, "coverage_end_date", "date", "coverage_end_date"),
        _field(c, "coverage_status", "enum", "coverage_status", True, "active terminated pending cancelled"),
        _field(c, "relationship_to_subscriber", "enum", "relationship_to_subscriber", True, "self spouse child dependent"),
        _field(c, "subscriber_id", "identifier", "subscriber_identifier"),
    )
    tables = (
        Table(m, members, ("member_id",), ("member_id",)),
        Table(p, plans, ("plan_id",), ("plan_id",)),
        Table(c, coverage, ("coverage_id",), ("coverage_id",), (("member_id", m, "member_id"), ("plan_id", p, "plan_id"))),
    )
    return Contract("healthcare_eligibility", "1.0.0", tables, "Healthcare eligibility", "healthcare", presets=PRESETS, status="published")


#: Named rule presets a contract may bind; see operators.rules.
PRESETS = ("birth_date", "coverage_dates", "dependents", "email", "phone", "gender", "plan_type", "terminated", "identity_conflicts", "duplicate_coverage", "plan_conflicts")

# Words of each enum kind and what they stand for.
CROSSWALKS = {
    "gender": {"m": "male", "male": "male", "f": "female", "female": "female", "o": "other", "other": "other", "u": "unknown", "unknown": "unknown", "x": "unknown"},
    "coverage_status": {"a": "active", "active": "active", "t": "terminated", "term": "terminated", "termed": "terminated", "terminated": "terminated", "p": "pending", "pending": "pending", "c": "cancelled", "cancelled": "cancelled", "canceled": "cancelled"},
    "relationship_to_subscriber": {"self": "self", "subscriber": "self", "employee": "self", "spouse": "spouse", "child": "child", "dependent": "dependent"},
    "plan_type": {"ppo": "PPO", "p p o": "PPO", "ppo plan": "PPO", "hmo": "HMO", "h m o": "HMO", "epo": "EPO", "e p o": "EPO", "hdhp": "HDHP", "high deductible": "HDHP", "high deductible health plan": "HDHP", "pos": "POS"},
}


def with_status(c: Contract, status: str) -> Contract:
    """The next status of the lifecycle draft, published, retired; any other step raises."""
    if STATUSES.index(status) != STATUSES.index(c.status) + 1:
        raise ContractError(f"A {c.status} contract can't become {status}.")
    return replace(c, status=status)
