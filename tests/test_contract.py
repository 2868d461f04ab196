"""Contracts refuse what is wrong with them, all of it at once."""

import copy

import pytest

from millrace.plans.contract import ContractError, definition, eligibility, load
from millrace.plans.fixtures import order_book_contract
from millrace.sources.store import Store


def at(raw, path):
    for p in path[:-1]:
        raw = raw[p]
    return raw


FIELD = ("tables", 0, "fields", 1)
FAULTS = [
    (("key",), "Bad Key", "key must be a lower-case identifier."), (("version",), "1.0", "version must be like 1.0.0."), (("name",), " ", "name is required."), (("domain",), None, "domain is required."),
    (("tables",), {}, "tables must be a list."), (("tables", 0), "members", "table 0 must be an object."), (("tables", 1, "name"), "members", "table members occurs twice."), (("tables", 0, "fields"), [], "table members has no fields."),
    ((*FIELD, "field"), "member_id", "members.member_id occurs twice."), ((*FIELD, "data_type"), "mystery", "members.first_name has an unknown data type 'mystery'."), ((*FIELD, "nullable"), True, "members.first_name must be either required or nullable."),
    ((*FIELD, "validation_kind"), "no_such", "members.first_name has an unknown validation kind 'no_such'."), ((*FIELD, "validation_rules"), {"kind": "email"}, "members.first_name validation_rules must be a list."),
    ((*FIELD, "validation_rules"), ["email"], "members.first_name rule 0 must be an object."), ((*FIELD, "validation_rules"), [{"kind": "no_such_rule"}], "members.first_name rule 0 has an unknown kind 'no_such_rule'."),
    ((*FIELD, "validation_rules"), [{"kind": "email", "severity": "fatal"}], "members.first_name rule 0 has an unknown severity 'fatal'."), ((*FIELD, "validation_rules"), [{"kind": "email", "parameters": [1]}], "members.first_name rule 0 parameters must be an object."),
    ((*FIELD, "validation_rules"), [{"kind": "numeric_range", "parameters": {"minimum": "5"}}], "members.first_name rule 0 minimum and maximum must be numbers."), ((*FIELD, "validation_rules"), [{"kind": "numeric_range", "parameters": {"minimum": 5, "maximum": 1}}], "members.first_name rule 0 has a minimum above its maximum."),
    ((*FIELD, "generation_strategy"), "random", "members.first_name has an unknown generation strategy 'random'."), ((*FIELD, "generation_strategy"), "deterministic_business_key", "members.first_name has a generation strategy but isn't generated."),
    (("tables", 0, "fields", 4, "allowed_values"), [], "members.gender is an enum without allowed values."), (("tables", 2, "fields", 0, "input_fields"), ["nothing"], "member_coverage.coverage_id is made of the unknown field 'nothing'."),
    (("tables", 0, "primary_key"), [], "table members has no primary key."), (("tables", 0, "primary_key"), ["x"], "table members has a key on the unknown field 'x'."), (("tables", 0, "primary_key"), "member_id", "table members primary_key must be a list."),
    (("tables", 2, "foreign_keys", 0, "field"), "x", "table member_coverage has a foreign key on the unknown field 'x'."), (("tables", 2, "foreign_keys", 0, "table"), "x", "table member_coverage refers to the unknown table 'x'."), (("tables", 2, "foreign_keys", 0, "references"), "x", "table member_coverage refers to the unknown field members.x."),
    (("reconciliation_policy",), [1], "reconciliation_policy must be an object."), (("reconciliation_policy", "max_reject_rate"), "x", "max_reject_rate must be between 0 and 1."), (("reconciliation_policy", "max_reject_rate_severity"), "fatal", "max_reject_rate_severity must be error or warning."), (("presets",), ["no_such"], "the rule preset 'no_such' is unknown."),
]


@pytest.mark.parametrize(("path", "value", "message"), FAULTS, ids=[m for *_, m in FAULTS])
def test_each_fault_is_named(path, value, message):
    raw = copy.deepcopy(definition(eligibility()))
    at(raw, path)[path[-1]] = value
    with pytest.raises(ContractError) as e:
        load(raw)
    assert message in str(e.value).split("\n")


def test_faults_are_gathered():
    raw = copy.deepcopy(definition(eligibility()))
    for path, value, _ in FAULTS[:4]:
        at(raw, path)[path[-1]] = value
    with pytest.raises(ContractError) as e:
        load(raw)
    assert str(e.value).split("\n") == [m for *_, m in FAULTS[:4]]
    with pytest.raises(ContractError):
        load([])


def test_sound_contracts_load_under_either_set_of_names():
    for c in (eligibility(), order_book_contract()):
        raw = definition(c)
        assert load(raw).checksum == c.checksum
        other = {"contract_key": raw["key"], **{k: v for k, v in raw.items() if k != "key"}}
        other["tables"] = [{**t, "fields": [{("name" if k == "field" else k): v for k, v in f.items()} for f in t["fields"]], "foreign_keys": [{"field": k["field"], "references_table": k["table"], "references_field": k["references"]} for k in t["foreign_keys"]]} for t in raw["tables"]]
        assert load(other).checksum == c.checksum


def test_registry_is_by_name_and_newest_first(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for key, name, version in (("b", "Alpha", "2.0.0"), ("a", "Beta", "1.0.0"), ("b", "Alpha", "10.0.0"), ("b", "Alpha", "9.1.0")):
        store.save_contract(load({**definition(order_book_contract()), "key": key, "name": name, "version": version}))
    assert [(c.name, c.version) for c in store.contracts()] == [("Alpha", "10.0.0"), ("Alpha", "9.1.0"), ("Alpha", "2.0.0"), ("Beta", "1.0.0")]
