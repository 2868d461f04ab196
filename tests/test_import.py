"""One import end to end: rules, outputs, rejects, lineage, reconciliation, corrections, publish, replay."""

import dataclasses
import datetime
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import corrections, normalize, outputs, pipeline, profile, reconcile, rules
from millrace.plans import mapping, report, templates
from millrace.plans.contract import Contract, ContractError, definition, eligibility, load, with_status
from millrace.plans.fixtures import COLUMNS, CONTRACT, identity_mappings
from millrace.plans.mapping import ConfigurationError, Mapping, Step
from millrace.sources import ingest
from millrace.sources.checkpoint import cut
from millrace.sources.store import ReconciliationError, Store

def asof():
    return F.lit("2026-01-01").cast("date")

CLEAN = ("MEM1", " Ann ", "Lee", "1990-05-01", "F", "ann@x.org", "555-010-1234", "P1", "Silver", "P.P.O", "Acme", "2024-01-01", "", "Active", "Self", "MEM1")

pytestmark = pytest.mark.usefixtures("interpreted")


def row(**changes):
    return tuple(changes.get(c, v) for c, v in zip(COLUMNS, CLEAN, strict=True))


def frame(spark, rows):
    return spark.createDataFrame([(i + 2, *r) for i, r in enumerate(rows)], "source_row_number int, " + ", ".join(f"`{c}` string" for c in COLUMNS))


class Run:
    def __init__(self, spark, rows, mappings=None, contract=CONTRACT):
        self.source = frame(spark, rows)
        self.flat = pipeline.build_flat(self.source, mappings or identity_mappings(), contract, trace=True)
        self.typed = cut(normalize.normalize(self.flat.df, contract))
        self.issues = cut(rules.validate(self.typed, contract, self.flat, asof()))
        self.merged = outputs.tables(self.typed, self.issues, contract)
        self.plain = {t.name: outputs.output(self.merged[t.name], t) for t in contract.tables}

    def codes(self, n=None):
        rows = self.issues if n is None else self.issues.where(F.col("source_row_number") == n)
        return sorted(r.issue_code for r in rows.collect())

    def checks(self):
        stats = [outputs.table_stats(self.merged[t.name], t).first().asDict() for t in CONTRACT.tables]
        lost = {t.name: reconcile.orphan_count(self.plain, t) for t in CONTRACT.tables}
        return reconcile.transform_checks(rules.counts(self.typed, self.issues).first().asDict(), stats, lost, CONTRACT)


ROW_RULES = [
        ({"dob": "2030-01-01"}, "date_of_birth_future"), ({"dob": "1890-01-01"}, "date_of_birth_age_out_of_range"), ({"dob": "1979-02-30"}, "date_of_birth_missing_or_invalid"), ({"effective_date": "2025-06-01", "term_date": "2024-01-01"}, "coverage_end_before_start"),
        ({"relation": "Child", "subscriber_id": " "}, "dependent_missing_subscriber_id"), ({"relation": "Child", "subscriber_id": "MEM9"}, "subscriber_id_not_found"), ({"email_address": ""}, "email_missing"), ({"email_address": "nope"}, "email_invalid"),
        ({"phone": "12"}, "phone_invalid"), ({"sex": "?"}, "gender_unknown"), ({"plan_type": "Mystery"}, "plan_type_unknown"), ({"status": "Termed"}, "terminated_missing_coverage_end_date"), ({"term_date": "soon"}, "coverage_end_date_invalid_date"), ({"first": "\t"}, "first_name_missing_or_invalid"), ({"status": "?"}, "coverage_status_missing_or_invalid"),
]


def test_each_row_rule(spark):
    """All cases as rows of one file, each with a member and a plan of its own."""
    rows = [row(**{"member_number": f"R{i}", "subscriber_id": f"R{i}", "plan_code": f"P{i}"} | changes) for i, (changes, _) in enumerate(ROW_RULES)]
    got = {}
    for x in Run(spark, rows).issues.collect():
        got.setdefault(x.source_row_number - 2, []).append(x.issue_code)
    assert got == {i: [code] for i, (_, code) in enumerate(ROW_RULES)}


def test_set_rules_and_clean_rows(spark):
    r = Run(spark, [row(), row(last="Other"), row(member_number="MEM2", subscriber_id="MEM2", plan_name="Gold"), row(member_number="MEM3", subscriber_id="MEM3", plan_code="P2")])
    assert r.codes(2) == r.codes(3) == ["duplicate_coverage_period", "duplicate_member_id_conflicting_identity", "plan_id_conflicting_attributes"]
    assert r.codes(4) == ["plan_id_conflicting_attributes"] and r.codes(5) == []
    assert Run(spark, []).codes() == []


def test_outputs_rejects_and_lineage(spark):
    r = Run(spark, [row(), row(effective_date="2025-01-01", term_date="2024-01-01", email_address="x", phone="1"), row(member_number="MEM3", subscriber_id="MEM3", dob="2035-01-01")])
    assert {n: df.count() for n, df in r.plain.items()} == {"members": 1, "plans": 1, "member_coverage": 1}
    rejected = {x.source_row_number: x for x in outputs.rejected_rows(r.source, r.issues).collect()}
    assert set(rejected) == {3, 4} and len(outputs.rejected_rows(r.source, r.issues).columns) == 12 + 16
    assert rejected[3].error_codes == "coverage_end_before_start" and rejected[3].warning_codes == "email_invalid; phone_invalid" and rejected[4].original__dob == "2035-01-01"
    lines = outputs.lineage(r.flat, r.typed, r.issues, "hash").collect()
    assert len(lines) == 3 * 19 and lines[0].asDict().keys() == set(outputs.LINEAGE)
    state = {(x.source_row_number, x.target_field): x.lineage_status for x in lines}
    assert state[2, "first_name"] == "accepted" and state[4, "date_of_birth"] == "error" and state[3, "email"] == "warning" and state[3, "last_name"] == "not_published_row_rejected"
    made = next(x for x in lines if x.source_row_number == 2 and x.target_field == "coverage_id")
    assert made.final_value.startswith("COV-") and "generate_deterministic_id" in made.transformation_trace_json


def test_coalescing_by_key(spark):
    t = CONTRACT.table("plans")
    make = lambda rows: outputs.coalesce_by_key(spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "source_row_number int, plan_id string, plan_name string, plan_type string, carrier_name string"), t)
    same = make([("P", "N", None, None), ("P", "N", "PPO", " "), ("P", "N", "PPO", "C"), (None, "N", None, None), (None, "N", None, None)])
    got = {x.plan_id: (x.plan_type, x.carrier_name) for x in outputs.output(same, t).collect()}
    assert got == {"P": ("PPO", "C"), None: (None, None)}
    s = outputs.table_stats(same, t).first()
    assert (s.candidate_count, s.unique_business_key_count, s.exact_duplicate_count, s.conflicting_duplicate_count) == (5, 2, 3, 0)
    assert outputs.table_stats(make([("P", "N", "HMO", None), ("P", "N", "PPO", None)]), t).first().conflicting_duplicate_count == 2
    assert outputs.table_stats(make([]), t).first().candidate_count == 0


def test_coalescing_takes_values_late(spark):
    """No value is in an aggregate: the plan has no SortAggregate, and random rows give what a plain loop gives."""
    rng, t = random.Random(6), CONTRACT.table("members")
    pick = lambda xs: rng.choice([None, None, "", " ", *xs])
    days = [datetime.date(1990, 1, d) for d in (1, 2)]
    rows = [(n, pick("AB") if n % 9 else None, pick(["x", "y"]), pick(["L"]), rng.choice([None, *days]), pick(["male"]), pick(["a@b.c", "d@e.f"]), pick(["1"])) for n in rng.sample(range(1000), 120)]
    names = [f.name for f in t.fields]
    df = spark.createDataFrame(rows, "source_row_number int, member_id string, first_name string, last_name string, date_of_birth date, gender string, email string, phone string").repartition(5)
    df = cut(df)
    got = outputs.coalesce_by_key(df, t)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "SortAggregate" not in outputs.key_facts(df, t)._jdf.queryExecution().executedPlan().toString()
    want = {}
    filled = lambda v: v is not None and str(v).strip() != ""
    for r in sorted(rows):
        want.setdefault(r[1], []).append(r[1:])
    expected = {}
    for key, group in want.items():
        values = [key] + [next((r[k] for r in group if filled(r[k])), None) for k in range(1, len(names))]
        conflict = any(len({r[k] for r in group if filled(r[k])}) > 1 for k in range(1, len(names)))
        lacking = sum(any(not filled(r[k]) for k, f in enumerate(t.fields) if f.required) for r in group)
        expected[key] = (*values, len(group), conflict, lacking)
    assert {r[0]: tuple(r) for r in got.collect()} == expected


def test_ids_ignore_row_order(spark):
    rows = [row(), row(member_number="MEM2", subscriber_id="MEM2")]
    ids = lambda rs: {x.coverage_id for x in Run(spark, rs).plain["member_coverage"].collect()}
    assert ids(rows) == ids(rows[::-1]) and len(ids(rows)) == 2


def test_reconciliation_status(spark):
    assert reconcile.status_of(Run(spark, [row()]).checks()) == "PASS"
    assert reconcile.status_of(Run(spark, [row(), row(member_number="M5", dob="bad")]).checks()) == "WARNING"
    conflict = Run(spark, [row(term_date="2025-02-01"), row(term_date="2025-01-01")])
    assert reconcile.status_of(conflict.checks()) == "FAIL"
    ack = reconcile.transform_checks({"source_count": 1, "accepted_count": 1, "rejected_count": 0, "reject_rate": 0.0}, [], {}, CONTRACT, acknowledged=1)
    assert reconcile.status_of(ack) == "WARNING"


def test_corrections_round_trip(spark):
    r = Run(spark, [row(), row(member_number="MEM2", subscriber_id="MEM2", dob="bad", email_address="a@b.c")])
    queue = cut(corrections.work_queue(outputs.rejected_rows(r.source, r.issues), r.source, "h"))
    columns = corrections.source_columns(r.source)
    up = queue.withColumn("corrected__dob", F.lit("1980-01-01")).withColumn("corrected__email_address", F.lit(None).cast("string")).withColumn("correction_comment", F.lit("phoned"))
    found = cut(corrections.overlays(corrections.checked_upload(up, queue, columns)))
    fixed = cut(corrections.apply_overlays(r.source, found))
    got = {x.source_row_number: x for x in fixed.collect()}
    assert got[3].dob == "1980-01-01" and got[3].email_address is None and got[2].dob == "1990-05-01"
    assert sorted(x.source_column for x in corrections.audit(found, r.source).collect()) == ["dob", "email_address"]
    again = pipeline.build_flat(fixed, identity_mappings(), CONTRACT)
    issues = rules.validate(normalize.normalize(again.df, CONTRACT), CONTRACT, again, asof())
    assert corrections.recovery(found, issues).first().recovery_status == "recovered"
    bad = up.withColumn("original_row_fingerprint", F.lit("0"))
    assert "mismatch" in corrections.checked_upload(bad, queue, columns).first().error
    assert corrections.checked_upload(up.unionByName(up), queue, columns).first().error.startswith("Duplicate")
    assert corrections.checked_upload(up.withColumn("source_record_id", F.lit("?")), queue, columns).first().error.startswith("Unknown")
    with pytest.raises(ValueError):
        corrections.checked_upload(up.drop("correction_comment"), queue, columns)
    with pytest.raises(Exception, match="mismatch"):
        corrections.apply_overlays(r.source, found.withColumn("original_row_fingerprint", F.lit("0"))).collect()


def test_publish_replay_and_rollback(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    c = store.ensure_contract(eligibility())
    assert c.status == "published" and store.ensure_contract(eligibility()).checksum == c.checksum
    r = Run(spark, [row(), row(member_number="MEM2", subscriber_id="MEM2")])
    first = store.publish(r.plain, c, file_hash="h1", checks=r.checks(), details={"issues": r.issues})
    assert first.expected == {"members": {"insert": 2}, "plans": {"insert": 1}, "member_coverage": {"insert": 2}}
    again = store.publish(r.plain, c, file_hash="h1", checks=r.checks())
    assert again.expected["members"] == {"unchanged": 2} and store.replay("h1")["id"] == again.run_id and store.replay("new") is None
    changed = Run(spark, [row(last="Changed")])
    assert store.publish(changed.plain, c, file_hash="h2", checks=changed.checks()).expected["members"] == {"update": 1}
    assert {x.last_name for x in store.table("members").collect()} == {"Changed", "Lee"}
    warned = Run(spark, [row(), row(member_number="M9", dob="bad")])
    with pytest.raises(ValueError):
        store.publish(warned.plain, c, file_hash="h3", checks=warned.checks())
    store.publish(warned.plain, c, file_hash="h3", checks=warned.checks(), reviewer="R")
    before = store.files.names("manifests")
    broken = Run(spark, [row(term_date="2025-02-01"), row(term_date="2025-01-01")])
    with pytest.raises(ReconciliationError):
        store.publish(broken.plain, c, file_hash="h4", checks=broken.checks(), reviewer="R")
    assert store.files.names("manifests") == before and store.runs()[-1]["status"] == "reconciliation_failed"
    assert store.audit("issues") is not None and store.audit("reconciliation").where("stage = 'failed'").count() > 0 and store.alive()


def test_contract_lifecycle(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    raw = definition(eligibility())
    assert load(raw).checksum == eligibility().checksum
    draft = load(raw)
    store.save_contract(draft)
    with pytest.raises(ContractError):
        store.save_contract(draft)
    done = store.transition(draft, "published")
    assert store.contract(draft.key, draft.version).status == "published" and [x.version for x in store.contracts(("published",))] == ["1.0.0"]
    with pytest.raises(ContractError):
        with_status(done, "draft")
    with pytest.raises(Exception):
        store.transition(draft, "published")
    raw["version"], raw["tables"][0]["fields"][0]["data_type"], raw["tables"][2]["foreign_keys"][0]["table"] = "1", "blob", "nowhere"
    with pytest.raises(ContractError) as e:
        load(raw)
    assert len(str(e.value).split("\n")) == 3


def test_clashing_fields_and_bad_pipelines(spark):
    other = [m if (m.table, m.field) != ("member_coverage", "member_id") else Mapping("member_coverage", "member_id", ("last",)) for m in identity_mappings()]
    r = Run(spark, [row(), row()], other)
    assert r.codes().count("conflicting_duplicate_target_field") == 2
    with pytest.raises(ConfigurationError):
        Run(spark, [row()], [Mapping("members", "first_name", ("nowhere",))])
    with pytest.raises(ConfigurationError):
        Run(spark, [row()], [Mapping("members", "first_name", ("first",), (Step("regex_replace", {"pattern": "(", "replacement": ""}),))])
    failed = Run(spark, [row(dob="bad")], identity_mappings({"date_of_birth": [Step("parse_date", {"accepted_formats": []})]}))
    assert failed.codes() == ["date_of_birth_missing_or_invalid", "transformation_parse_date_failed"]
    shown = pipeline.preview(frame(spark, [row(), row(dob="bad")]), Mapping("members", "date_of_birth", ("dob",), (Step("parse_date", {"accepted_formats": []}),)), CONTRACT).collect()
    assert [x.status for x in shown] == ["ready", "failed"]


def test_profile_and_mapping(spark):
    rows = [(i + 2, f"M{i:03d}", f"19{70 + i % 20}-01-0{1 + i % 9}", f"u{i}@x.org", "A", None) for i in range(30)]
    df = spark.createDataFrame(rows, "source_row_number int, `Member Number` string, DOB string, `Email Address` string, Status string, `Legacy ID` string")
    p = {x.column_name: x for x in profile.profile(df).collect()}
    assert p["DOB"].inferred_type == "date" and p["Email Address"].inferred_type == "email" and p["Status"].enum_coverage_status == "active" and p["Legacy ID"].null_rate == 1.0 and p["DOB"].min_date == "1970-01-01"
    profiles = profile.profiles_for_mapping(df)
    found = {(m.table, m.field): m for m in mapping.suggest(profiles, CONTRACT)}
    assert found["members", "date_of_birth"].confidence >= 85 and found["members", "member_id"].columns == ("Member Number",)
    assert found["member_coverage", "coverage_status"].needs_review and found["plans", "plan_name"].status == "unmapped"
    wrong = mapping.align([Mapping("members", "date_of_birth", ("Email Address",)), Mapping("members", "member_id", ("?",)), Mapping("members", "gender")], profiles, CONTRACT)
    assert [m.alignment for m in wrong] == ["mismatch", "unknown_source", "not_mapped"] and len(mapping.blocking(wrong)) == 2
    unused = {x["column_name"]: x for x in mapping.source_coverage(profiles, [Mapping("members", "member_id", ("Member Number",))])}
    assert unused["Legacy ID"]["status"] == "unused" and unused["Legacy ID"]["needs_review"] and unused["Member Number"]["status"] == "approved_mapped"
    assert len(mapping.required_gaps([], CONTRACT)) == sum(f.required and not f.generated for f in CONTRACT.fields)
    assert mapping.column_key("MEMBER_NO") == "member number" and mapping.column_key("Eff-Dt") == "effective date"
    drafted = mapping.draft_mappings(profiles, CONTRACT, lambda payload: {"mappings": [{"target_table": "members", "target_field": "gender", "source_columns": ["Status"], "confidence": 40}]})
    assert next(m for m in drafted if m.field == "gender").columns == ("Status",)
    answer = mapping.response_schema(profiles, CONTRACT)["properties"]["mappings"]["items"]
    assert "coverage_id" not in answer["properties"]["target_field"]["enum"] and answer["additionalProperties"] is False
    for bad in ({"target_field": "x"}, {"source_columns": ["?"]}, {"confidence": 101}, {"transformation_steps": [{"operation": "eval"}]}):
        with pytest.raises(ConfigurationError):
            mapping.read_draft({"mappings": [{"target_table": "members", "target_field": "gender", "source_columns": [], "confidence": 1} | bad]}, profiles, CONTRACT)


def test_templates(tmp_path):
    folder = str(tmp_path)
    mine = [Mapping("members", "member_id", ("Member Number",), (Step("trim", {}),)), Mapping("members", "gender", ("Sex",))]
    assert templates.save("My File", mine, CONTRACT, ["Member Number", "Sex"], folder) == "my-file__1-0-0.json"
    assert templates.save("My File", mine, CONTRACT, [], folder) == "my-file__2-0-0.json"
    got = templates.applied(templates.read("my-file__1-0-0.json", folder), CONTRACT, ["Member Number"])
    assert not got[0].approved and got[0].steps == mine[0].steps and got[1].columns == () and got[1].status == "unmapped"
    with pytest.raises(ConfigurationError):
        templates.applied({"contract_version": "9.9.9"}, CONTRACT, [])
    old = templates.applied({"mappings": [{"target_table": "members", "target_field": "gender", "source_column": "Sex"}]}, CONTRACT, ["Sex"])
    assert old[0].columns == ("Sex",)
    assert mapping.checksum(mine) == mapping.checksum(mine[::-1])


def test_csv_and_fingerprints(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text('id,note\n001,"a ""q"", b"\nN/A,"two\nlines"\n007,\n')
    df = ingest.read_csv(spark, str(p))
    assert [tuple(r) for r in df.orderBy("source_row_number").collect()] == [(2, "001", 'a "q", b'), (3, None, "two\nlines"), (4, "007", None)]
    f = lambda d: ingest.file_fingerprint(d, ["id", "note"]).first().fingerprint
    assert f(df) == f(df.repartition(3)) != f(df.withColumn("id", F.lit("x")))
    ingest.write_csv(df, str(tmp_path / "out"))
    assert ingest.read_csv(spark, str(tmp_path / "out")).count() == 3


def test_report(spark):
    r = Run(spark, [row(), row(member_number="M<b>", dob="bad")])
    data = report.report_data(r.typed, r.issues, r.checks(), {"rejected": outputs.rejected_rows(r.source, r.issues)})
    page = report.render_html(data)
    assert data["status"] == "Ready for publish" and "M&lt;b&gt;" in page and "<b>" not in page
    assert b'"status": "WARNING"' in report.checks_json(r.checks())


def test_generated_ids_of_other_contracts(spark):
    raw = {"key": "k", "version": "1.0.0", "name": "K", "domain": "d", "tables": [{"name": "t", "primary_key": ["t_id"], "fields": [{"field": "t_id", "data_type": "identifier", "required": True, "generated": True, "generation_strategy": "deterministic_business_key", "input_fields": ["a"]}, {"field": "a", "data_type": "text", "required": True}, {"field": "b", "data_type": "numeric", "validation_rules": [{"kind": "numeric_range", "severity": "error", "parameters": {"maximum": 5}}]}]}]}
    c: Contract = load(raw)
    src = spark.createDataFrame([(2, "x", "1"), (3, "x", "2"), (4, "y", "9")], "source_row_number int, a string, b string")
    flat = pipeline.build_flat(src, [Mapping("t", "a", ("a",)), Mapping("t", "b", ("b",))], c)
    typed = normalize.normalize(flat.df, c)
    issues = rules.validate(typed, c, flat, asof())
    assert [x.issue_code for x in issues.collect()] == ["b_out_of_range"]
    got = outputs.output(outputs.tables(typed, issues, c)["t"], c.tables[0]).collect()
    assert len(got) == 1 and got[0].t_id.startswith("T-") and got[0].b == 1.0


def test_failures_of_any_kind_are_kept(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    c = store.ensure_contract(eligibility())
    r = Run(spark, [row()])
    store.publish(r.plain, c, file_hash="h1", checks=r.checks())
    own = [x.member_id for x in store.table("members").where("import_run_id = 1").collect()]
    assert len(own) == 1
    before = store.files.names("manifests")
    broken = r.plain | {"members": r.plain["members"].withColumn("last_name", F.raise_error(F.lit("broken")).cast("string"))}
    with pytest.raises(Exception, match="broken"):
        store.publish(broken, c, file_hash="h2", checks=r.checks())
    last = max(store.runs(), key=lambda x: x["id"])
    assert last["status"] == "failed" and "broken" in last["error"] and store.files.names("manifests") == before and store.replay("h2") is None
    changed = Run(spark, [row(member_number="MEM7", subscriber_id="MEM7")])
    store.publish(changed.plain, c, file_hash="h3", checks=changed.checks())
    assert {x.member_id: x.import_run_id for x in store.table("members").collect()} == {own[0]: 1, "MEM7": 3}
    assert store._latest()[1]["keys"]["members"]["business_key"] == ["member_id"]


def test_run_numbers_are_taken_once(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    assert [a._run_id(), b._run_id(), a._run_id()] == [1, 2, 3]


def test_templates_are_kept_by_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    raw = {"template_name": "Carrier A", "template_version": "1.0.0", "mappings": [{"target_table": "members"}]}
    assert store.keep_template(raw) == store.keep_template(dict(raw)) and store.template("Carrier A", "1.0.0") == raw
    with pytest.raises(ValueError):
        store.keep_template(raw | {"mappings": []})
    assert store.template("Carrier A", "2.0.0") is None


def test_csv_files_are_numbered_in_order(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.csv").write_text("k,v\n" + "".join(f"{i},x\n" for i in range(50)))
    (path / "b.csv").write_text("k,v\n50,NA\n51,\n")
    rows = ingest.read_csv(spark, str(path)).collect()
    assert sorted((r.source_row_number, int(r.k)) for r in rows) == [(i + 2, i) for i in range(52)] and {r.v for r in rows} == {"x", None}
    (path / "b.csv").write_text('k,v\n50,"two\nlines"\n')
    assert ingest.quoted_newlines(spark, str(path)) and {r.v for r in ingest.read_csv(spark, str(path)).collect()} == {"x", "two\nlines"}


def test_mapping_flags():
    fields = {f.name: f for f in CONTRACT.fields}
    base = {"inferred_type": "text", "null_rate": 0.0, "unique_rate": 0.1, "date_parse_rate": 0.0, "email_pattern_rate": 0.0, "phone_pattern_rate": 0.0, "samples": ["x"], "known_enum_matches": {}}
    profiles = [base | {"column_name": "dob", "normalized_name": "dob"}, base | {"column_name": "status", "normalized_name": "status", "known_enum_matches": {"coverage_status": ["active"]}}]
    found = {(m.table, m.field): m for m in mapping.suggest(profiles, CONTRACT)}
    born, state = found["members", "date_of_birth"], found["member_coverage", "coverage_status"]
    assert (born.confidence, born.status, born.flags, born.needs_review, born.alignment) == (60, "weak_suggestion", ("target_type_mismatch",), True, "mismatch")
    assert (state.confidence, state.status, state.flags) == (80, "suggested", ("ambiguous_status",))
    assert found["members", "member_id"].flags == ("required_unmapped",) and found["members", "member_id"].needs_review and not found["members", "email"].needs_review
    assert mapping.value_score(base | {"unique_rate": 0.9}, fields["member_id"]) == 30 and mapping.code_rate(["A1", "abc", "ABC", "a" * 30 + "1"]) == 0.5


def test_points_of_headers():
    """An alias once abbreviations are written out, a close spelling, shared words, nothing."""
    cases = [("mbr_no", "member_id", 70), ("Member Numbr", "member_id", 60), ("member key", "member_id", 25), ("start of coverage date", "coverage_start_date", 45), ("colour", "member_id", 0)]
    for header, field, points in cases:
        assert mapping.name_score(mapping.column_key(header), mapping.names_of(CONTRACT.by_name[field])) == points, header


def test_gates_of_a_mapping():
    """Two required fields without an approved mapping, one pipeline that nobody approved."""
    found = [m for m in identity_mappings({"date_of_birth": [Step("parse_date", {"accepted_formats": []})]}) if (m.table, m.field) != ("members", "member_id")]
    found = [dataclasses.replace(m, approved=m.field != "coverage_status", steps_approved=m.field != "date_of_birth") for m in found]
    assert [(f.table, f.name) for f in mapping.required_gaps(found, CONTRACT)] == [("members", "member_id"), ("member_coverage", "coverage_status")]
    assert [(m.table, m.field) for m in mapping.unapproved_steps(found)] == [("members", "date_of_birth")]
