"""One reject code per bad row, suites, runs and graphs."""

import random

from pyspark.sql import functions as F

from evidgrid.functions.identity import content_sha
from evidgrid.operators import clusters as cl
from evidgrid.operators import graph as gr
from evidgrid.operators import metrics as mt
from evidgrid.operators import rules as ru
from evidgrid.operators import runs as rn
from evidgrid.operators import suite as su

BLOCKS = "block_id string, doc string, heading_path array<string>, raw string, protected boolean"
EVENTS = (
    "event_id string, text string, source_kind string, session_id string, locator string, correction_score int, "
    "directive_score int, authority int, corroboration int, scope string, ts timestamp, content_sha256 string"
)


def blocks(spark):
    return spark.createDataFrame(
        [
            ("d1", "f", ["Git"], "- Commit only when asked.\n", False),
            ("d2", "f", ["Git"], "- Run `make lint` before review.\n", False),
            ("d3", "f", ["Other"], "- Keep notes short and simple.\n", False),
            ("d4", "f", ["Git"], "- Guarded text stays.\n", True),
            ("d5", "g", ["Git"], "- Run `make lint` before review.\n", False),
        ],
        BLOCKS,
    )


def events(spark):
    rows = [
        ("e1", "New rule: commit completed work by default, always.", "history", "s1", "l1", 14, 3),
        ("e2", "Please commit completed work without asking me again.", "history", "s2", "l2", 0, 1),
        ("e3", "ok", "history", "s3", "l3", 0, 0),
        ("e4", "Please review the notes section together tomorrow.", "history", "s1", "l4", 0, 0),
    ]
    full = [(*r, 3, 1, "global", None, "h" + r[0]) for r in rows]
    return spark.createDataFrame(full, EVENTS).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))


def nomination(index, **changes):
    row = {
        "index": index,
        "candidate_class": "temporal_supersession",
        "domain": "git",
        "source_ids": ["d1"],
        "evidence_ids": ["e1"],
        "behavioral_intent": "Commit completed work by default",
        "reason": "newer",
        "applies_when": "work is done",
        "does_not_apply_when": "asked otherwise",
    }
    return {**row, **changes}


NOMINATIONS = (
    "index int, candidate_class string, domain string, source_ids array<string>, evidence_ids array<string>, "
    "behavioral_intent string, reason string, applies_when string, does_not_apply_when string"
)


def frame(spark, rows, schema):
    names = [part.split()[0] for part in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def test_nominations(spark):
    cases = [
        ({}, None),
        ({}, "duplicate_semantic_nomination"),
        ({"candidate_class": "nonsense"}, "invalid_semantic_nomination"),
        ({"source_ids": ["zz"]}, "invalid_semantic_nomination"),
        ({"source_ids": []}, "invalid_semantic_nomination"),
        ({"candidate_class": "missing_rule"}, "invalid_missing_rule"),
        ({"source_ids": ["d4"]}, "protected_change"),
        ({"evidence_ids": []}, "missing_evidence"),
        ({"evidence_ids": ["zz"]}, "unknown_evidence"),
        ({"evidence_ids": ["e1", "e1"]}, "duplicate_evidence"),
        ({"evidence_ids": ["e3"]}, "insufficient_evidence_text"),
        ({"reason": "two\nlines"}, "invalid_semantic_nomination"),
        ({"reason": "password=abcdefghijk"}, "secret_in_semantic_nomination"),
        ({"behavioral_intent": "Entirely different wording here"}, "ungrounded_semantic_intent"),
        ({"candidate_class": "missing_rule", "source_ids": [], "evidence_ids": ["e2"]}, "insufficient_missing_rule_evidence"),
        ({"evidence_ids": ["e2"]}, "unproven_temporal_supersession"),
        ({"candidate_class": "enforcement_candidate"}, "insufficient_escalation_lineage"),
        ({"candidate_class": "contradiction", "source_ids": ["d1"], "evidence_ids": [], "behavioral_intent": "commit only when asked always"}, "unproven_semantic_contradiction"),
        ({"candidate_class": "contradiction", "source_ids": ["d2"], "evidence_ids": [], "behavioral_intent": "run make lint before review"}, "unproven_semantic_contradiction"),
        ({"candidate_class": "missing_rule", "source_ids": [], "evidence_ids": ["e1", "e2"]}, None),
        ({"candidate_class": "wrong_scope", "source_ids": ["d2", "d5"], "evidence_ids": [], "behavioral_intent": "run make lint before review"}, None),
        ({"candidate_class": "wrong_scope", "source_ids": ["d2"], "evidence_ids": [], "behavioral_intent": "run make lint before review"}, None),
    ]
    rows = frame(spark, [nomination(i, **c) for i, (c, _) in enumerate(cases)], NOMINATIONS)
    got = {r["index"]: r for r in ru.validate_nominations(rows, blocks(spark), events(spark)).collect()}
    assert [got[i].code for i in range(len(cases))] == [code for _, code in cases]
    assert got[0].admission == "mutable_candidate"
    assert got[19].admission == "suggestion_candidate"
    assert got[20].admission_reason == "cross_target_or_heading_requires_operator_resolution"
    assert got[21].admission_reason == "single_source_without_external_evidence"
    summary = ru.nomination_summary(ru.validate_nominations(rows, blocks(spark), events(spark))).first()
    assert (summary.nominations, summary.rejected_nominations, summary.wrong_scope) == (4, 18, 2)


CHANGES = (
    "index int, action string, source_ids array<string>, replacement string, screened string, destination string, "
    "heading_path array<string>, evidence_ids array<string>, reason string, minimum_apply_mode string, "
    "enforcement_target string, deterministic_check string, relocation_basis string"
)


def change(index, **changes):
    row = {
        "index": index, "action": "replace", "source_ids": ["d1"], "replacement": "- Commit completed work by default.", "screened": None,
        "destination": "f", "heading_path": ["Git"], "evidence_ids": ["e1"], "reason": "newer evidence", "minimum_apply_mode": "attended",
        "enforcement_target": "", "deterministic_check": "", "relocation_basis": "",
    }
    return {**row, **changes}


def test_changes_one_code_each(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta"
    cases = [
        ({}, None),
        ({"action": "drop"}, "invalid_action"),
        ({"source_ids": []}, "invalid_source_ids"),
        ({"source_ids": ["zz"]}, "unknown_directive"),
        ({"source_ids": ["d3"]}, "duplicate_disposition"),
        ({"source_ids": ["d4"]}, "protected_change"),
        ({"action": "escalate", "source_ids": ["d1", "d2"]}, "invalid_escalation"),
        ({"source_ids": ["d2", "d5"]}, "cross_target_change"),
        ({"destination": "h"}, "target_not_allowlisted"),
        ({"destination": "g"}, "invalid_destination"),
        ({"heading_path": [" "]}, "invalid_heading_path"),
        ({"heading_path": ["Else"]}, "invalid_heading_path"),
        ({"replacement": f"{long} and {long}"}, "repeated_replacement_phrase"),
        ({"replacement": ""}, "empty_replacement"),
        ({"action": "remove"}, "remove_with_text"),
        ({"action": "escalate"}, "escalation_with_text"),
        ({"replacement": "- Commit verified work."}, "undefined_verification_gate"),
        ({"reason": " "}, "missing_reason"),
        ({"minimum_apply_mode": "never"}, "invalid_apply_mode"),
        ({"enforcement_target": "other"}, "invalid_enforcement_target"),
        ({"enforcement_target": "hook"}, "invalid_enforcement_fields"),
        ({"relocation_basis": "organization"}, "invalid_relocation_basis"),
        ({"action": "relocate", "relocation_basis": "contextual"}, "unscoped_contextual_relocation"),
        ({"evidence_ids": []}, "missing_evidence"),
        ({"evidence_ids": ["zz"]}, "unknown_evidence"),
        ({"evidence_ids": ["e1", "e1"]}, "duplicate_evidence"),
        ({"evidence_ids": ["e3"]}, "insufficient_evidence_text"),
        ({"action": "escalate", "replacement": "", "enforcement_target": "hook", "deterministic_check": "run"}, "insufficient_escalation_lineage"),
        ({"replacement": "- Commit after all CI checks pass."}, "unsafe_precommit_ci_gate"),
        ({"replacement": "- Commit only when asked."}, "retained_reversed_clause"),
        ({"replacement": "- Commit immediately by default."}, "unsupported_intensifier"),
        ({"replacement": "- Finish the work by default."}, "dropped_explicit_action"),
        ({"replacement": "- Commit work and similar."}, "unsupported_action_catch_all"),
        ({"replacement": "- Commit and archive work."}, "ungrounded_operational_action"),
    ]
    targets = spark.createDataFrame([("f", False), ("g", False)], "doc string, scoped boolean")
    kept = spark.createDataFrame([("d3",)], "block_id string")
    batch = [change(i, **c) for i, (c, _) in enumerate(cases)]
    unique = []
    extra = []
    for row in batch:  # give every row copies of its blocks so that rows do not collide
        mapping = {b: f"{b}#{row['index']}" for b in ("d1", "d2", "d4", "d5")}
        unique.append({**row, "source_ids": [mapping.get(s, s) for s in row["source_ids"]]})
        extra.append(mapping)
    base = blocks(spark).collect()
    rows = [b for b in base if b.block_id == "d3"]
    for mapping in extra:
        rows += [(mapping[b.block_id], *b[1:]) for b in base if b.block_id in mapping]
    all_blocks = spark.createDataFrame([tuple(r) for r in rows], BLOCKS)
    checked = ru.validate_changes(frame(spark, unique, CHANGES), kept, all_blocks, events(spark), targets)
    got = {r["index"]: r.code for r in checked.collect()}
    assert [got[i] for i in range(len(cases))] == [code for _, code in cases]


def test_candidate_boundary_allows_source_only_changes(spark):
    targets = spark.createDataFrame([("f", False)], "doc string, scoped boolean")
    same = [("a", "f", ["Git"], "- Run `make lint` first.\n", False), ("b", "f", ["Git"], "- Run `make lint` first.\n", False), ("c", "f", ["Git"], "- Other words.\n", False)]
    rows = spark.createDataFrame(same, BLOCKS)
    clusters = spark.createDataFrame([("x", ["exact_duplicate"], "a"), ("x", ["exact_duplicate"], "b")], "cluster_id string, reasons array<string>, block_id string")
    def run(kept, **c):
        keep = spark.createDataFrame([(k,) for k in kept], "block_id string")
        df = frame(spark, [change(0, evidence_ids=[], **c)], CHANGES)
        return ru.validate_changes(df, keep, rows, events(spark), targets, clusters).first().code
    assert run(["b"], action="remove", replacement="", source_ids=["a"]) is None
    assert run([], action="remove", replacement="", source_ids=["a"]) == "missing_evidence"
    assert run([], source_ids=["c"]) == "outside_consolidation_candidate"
    assert run([], source_ids=["a", "b"], replacement="- Run lint first.") == "checkability_regression"
    assert run([], source_ids=["a", "b"], replacement="- Run `make lint` first.") is None


def test_suggestions(spark):
    noms = spark.createDataFrame([("n1", None, "missing_rule", "suggestion_candidate", ["e1"])], "nomination_id string, code string, candidate_class string, admission string, evidence_ids array<string>")
    targets = spark.createDataFrame([("f", False)], "doc string, scoped boolean")
    schema = "index int, nomination_id string, keyword string, rendered string, reason string, destination string, heading_path array<string>"
    rows = [
        (0, "n1", "SHOULD", "Commit completed work.", "r", "f", ["Git"]),
        (1, "n1", "SHOULD", "Commit completed work.", "r", "f", ["Git"]),
        (2, "zz", "SHOULD", "Commit completed work.", "r", "f", ["Git"]),
    ]
    got = {r["index"]: (r.code, r.requires_confirmation) for r in ru.validate_suggestions(spark.createDataFrame(rows, schema), noms, events(spark), targets).collect()}
    assert got == {0: (None, False), 1: ("duplicate_new_rule_suggestion", False), 2: ("unknown_missing_rule_nomination", False)}
    rows = [(0, "n1", "SHOULD", "Archive and delete work.", "r", "f", ["Git"])]
    row = ru.validate_suggestions(spark.createDataFrame(rows, schema), noms, events(spark), targets).first()
    assert (row.code, row.requires_confirmation) == ("ungrounded_operational_action", True)


def test_conflicts(spark):
    ev = spark.createDataFrame([("a", 3, "global", 1), ("b", 3, "global", 1), ("c", 2, "global", 1), ("d", 3, "global", 2)], "event_id string, authority int, scope string, ts int")
    conflicts = spark.createDataFrame([(1, ["x", "y"], ["a", "b"]), (2, ["x", "y"], ["a", "c"]), (3, ["x", "y"], ["a", "d"]), (4, ["x"], ["a", "b"])], "conflict_id int, block_ids array<string>, evidence_ids array<string>")
    got = {r.conflict_id: (r.status, r.decided_by, r.winner) for r in ru.conflict_ties(conflicts, ev).collect()}
    assert got == {
        1: ("unresolved", None, None),
        2: ("decision_precedence_determined", "authority", "c"),
        3: ("decision_precedence_determined", "time", "d"),
        4: ("invalid_decision_request", None, None),
    }
    seen = ru.conflict_ties(conflicts, ev).where("conflict_id = 1").select("conflict_key")
    again = {r.conflict_id: r.status for r in ru.conflict_ties(conflicts, ev, seen).collect()}
    assert again[1] == "decision_request_repeated"
    pairs = spark.createDataFrame([(1, "deploy releases early", "hold releases back"), (2, "deploy releases early", "hold releases back"), (3, "deploy releases early", "hold releases back")], "conflict_id int, subject_a string, subject_b string")
    texts = [
        (1, "t1", "Always deploy releases on friday"), (1, "t2", "Never deploy releases on friday, hold them"),
        (2, "t1", "Deploy releases or hold releases? These are mutually exclusive"), (2, "t2", "nothing"),
        (3, "t1", "Deploy releases"), (3, "t2", "Hold the door"),
    ]
    ground = spark.createDataFrame(texts, "conflict_id int, text_id string, text string")
    assert {r.conflict_id: r.collides for r in ru.structural_collisions(pairs, ground).collect()} == {1: True, 2: True, 3: False}


def test_exclusive_sets_without_pairing_them(spark):
    draw = random.Random(8)
    sets = set()
    for conflict in range(60):
        for _ in range(draw.randint(1, 5)):
            terms = tuple(sorted(draw.sample("abcde", draw.randint(1, 4))))
            sets.add((conflict, "p", terms))
    rows = [(c, p, list(t), draw.random() < 0.4) for c, p, t in sorted(sets)]
    want = {
        c for c, _, x, strict in rows for d, _, y, _ in rows if c == d and strict and set(x) - set(y) and set(y) - set(x)
    }
    table = spark.createDataFrame(rows, "conflict_id int, pair string, set array<string>, exclusive boolean")
    assert {r.conflict_id for r in ru._incomparable(table).collect()} == want


def test_detectors_respect_words_and_negation(spark):
    detectors = {"run_npm_test": ["npm test"], "run_pnpm_test": ["pnpm test"]}
    rows = [(1, ["Run `pnpm test`, not `npm test`, before creating the commit."]), (2, ["This is review-only, so do not run `pnpm test` or `npm test`."]), (3, ["Avoid it. Npm  test first, and then pnpm test"])]
    df = spark.createDataFrame(rows, "id int, steps array<string>")
    got = {r.id: r.actions for r in su.detect(df, detectors).collect()}
    assert got == {1: ["run_pnpm_test"], 2: [], 3: ["run_npm_test", "run_pnpm_test"]}
    allowed = df.withColumn("allowed", F.array(F.lit("run_npm_test")))
    assert {r.id: r.actions for r in su.detect(allowed, detectors).collect()}[3] == ["run_npm_test"]


def test_conformance_and_responses(spark):
    def fails(actions, required, forbidden, ordered):
        df = spark.createDataFrame([(actions, required, forbidden, ordered)], "a array<string>, r array<string>, f array<string>, o array<string>")
        return df.select(su.conformance(F.col("a"), F.col("r"), F.col("f"), F.col("o"))).first()[0]
    assert fails(["a", "b"], ["a"], ["c"], ["a", "b"]) == []
    assert fails(["b", "a"], ["a", "x"], ["b"], ["a", "b"]) == ["missing:x", "forbidden:b", "order"]
    assert fails(["b"], [], [], ["a", "b"]) == []
    cases = spark.createDataFrame([("c1",), ("c2",)], "case_ref string")
    rows = [("ok", "c1", ["s"]), ("ok", "c2", ["s"]), ("gap", "c1", ["s"]), ("twice", "c1", ["s"]), ("twice", "c1", ["s"]), ("twice", "c2", ["s"]), ("blank", "c1", [" "]), ("blank", "c2", ["s"]), ("long", "c1", ["s"] * 129), ("long", "c2", ["s"]), ("odd", "c3", ["s"]), ("odd", "c1", ["s"]), ("odd", "c2", ["s"])]
    got = su.validate_responses(spark.createDataFrame(rows, "run_id string, case_ref string, steps array<string>"), cases)
    assert {r.run_id: r.code for r in got.collect()} == {"ok": None, **{k: "invalid_verification_output" for k in ("gap", "twice", "blank", "long", "odd")}}


def test_verdicts(spark):
    rows = [("good", 0, 3, 3, True), ("flaky", 0, 2, 3, True), ("bad", 0, 3, 2, True), ("weak", 3, 3, 3, True), ("free", 3, 3, 3, False)]
    matrix = spark.createDataFrame(rows, "case_id string, control int, pre int, post int, control_must_underperform boolean")
    got = {r.case_id: (r.reasons, r.baseline_gap, r.improvement) for r in su.verdicts(matrix, 3).collect()}
    assert got == {
        "good": ([], False, False), "flaky": ([], True, True), "bad": (["candidate_failed", "behavior_regression"], False, False),
        "weak": (["control_not_weaker"], False, False), "free": ([], False, False),
    }
    assert su.suite_status(su.verdicts(matrix, 3)).first().status == "failed"


def test_contained_phrases_brute_force(spark):
    texts = [(1, "The quick brown  fox jumps over the lazy dog"), (2, "unquick brown fox jumpsuit"), (3, "lazy dogs"), (4, "")]
    phrases = [(1, "quick brown fox jumps"), (2, "lazy dog"), (3, "Over"), (4, "brown fox jumps over the"), (5, "not there at all")]
    want = {(t, p) for t, a in texts for p, b in phrases if " ".join(b.lower().split()) in " ".join(a.lower().split())}
    found = su.contained_phrases(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(phrases, "phrase_id int, phrase string"))
    assert {(r.text_id, r.phrase_id) for r in found.collect()} == want


def test_contained_phrases_without_inner_words_have_no_limit(spark):
    texts = [(i, f"alpha{i} beta{i * 3}x, gamma") for i in range(0, 5_000, 50)]
    phrases = [(i, f"a{i}") for i in range(5_000)] + [(9_000, "gamma"), (9_001, ", g"), (9_002, ""), (9_003, "x")]
    table = spark.createDataFrame(texts, "text_id int, text string")
    listed = spark.createDataFrame(phrases, "phrase_id int, phrase string")
    want = {(t, p) for t, a in texts for p, b in phrases if b and b in a}
    found = su.contained_phrases(table, listed)
    assert {(r.text_id, r.phrase_id) for r in found.collect()} == want
    assert su.contained_phrases(table, listed.limit(0)).count() == 0


def test_equal_positions_keep_the_order_of_the_allowed_actions(spark):
    detectors = {"alpha": ["run"], "beta": ["run tests"], "gamma": ["stop"]}
    rows = [(["run tests then stop"], ["beta", "alpha", "gamma"]), (["run tests then stop"], ["gamma", "alpha", "beta"])]
    table = spark.createDataFrame(rows, "steps array<string>, allowed array<string>")
    got = [r.actions for r in su.detect(table, detectors).collect()]
    assert got == [["beta", "alpha", "gamma"], ["alpha", "beta", "gamma"]]


def test_coverage_selectors_are_a_table(spark):
    blocks = [("/a/x.md", ["Top", "Rules"]), ("/a/y.md", ["Top"]), ("/b/x.md", ["Other"]), ("", ["Top"])]
    selectors = [("x.md", "rules"), ("/y.md", "*"), ("z", "*")] + [(f"s{i}", "*") for i in range(2_000)]
    found = su.coverage_gaps(
        spark.createDataFrame(blocks, "doc string, heading_path array<string>"),
        spark.createDataFrame(selectors, "suffix string, contained string"),
    )
    assert {r.doc for r in found.collect()} == {"/b/x.md", ""}


def test_reference_graph(spark):
    docs = [
        ("/p/ROOT.md", "See @a.md, `@code.md` and @~/h.md.\n```\n@fenced.md\n```\nmail@x.y"),
        ("/p/a.md", "@./b.md @../p/c.md"), ("/p/b.md", "@d.md"), ("/p/c.md", ""), ("/p/d.md", "@e.md"), ("/p/e.md", "@f.md"), ("/p/f.md", ""),
        ("/home/user/h.md", "@h2.md"), ("/home/user/h2.md", "@h.md"),
    ]
    df = spark.createDataFrame(docs, "doc string, content string")
    edges = gr.reference_edges(df)
    assert ("/p/ROOT.md", "/home/user/h.md") in {(r.src, r.dst) for r in edges.collect()}
    assert edges.count() == 9 - 0 and not edges.where("dst like '%code%' or dst like '%fenced%'").count()
    roots = spark.createDataFrame([("/p/ROOT.md",)], "node string")
    codes = {(r.code, r.src, r.dst) for r in gr.closure_violations(roots, edges, df).collect()}
    assert codes == {
        ("depth_exceeded", "/p/e.md", "/p/f.md"),
        ("circular_reference", "/home/user/h.md", "/home/user/h2.md"),
        ("circular_reference", "/home/user/h2.md", "/home/user/h.md"),
        # a cycle can be walked for ever, so it is too deep as well
        ("depth_exceeded", "/home/user/h2.md", "/home/user/h.md"),
    }
    short = df.where("doc not in ('/p/f.md', '/home/user/h2.md')")
    ends = gr.closure_violations(roots, gr.reference_edges(short), short)
    assert {(r.code, r.dst) for r in ends.collect()} == {
        ("dangling_reference", "/home/user/h2.md"), ("dangling_reference", "/p/f.md"), ("depth_exceeded", "/p/f.md"),
    }
    diff = gr.graph_diff(edges, gr.reference_edges(short))
    assert {(r.change, r.src) for r in diff.collect()} == {("removed", "/home/user/h2.md")}


def test_reference_chains(spark):
    links = [
        ("r", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"),
        ("r", "x"), ("x", "gone"), ("x", "x"), ("s", "t"), ("t", "u"), ("other", "lost"),
    ]
    edges = spark.createDataFrame(links, "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "r a b c d e f x s t u other".split()], "doc string")
    roots = spark.createDataFrame([("r",), ("s",)], "node string")
    found = gr.reference_chains(roots, edges, nodes, 4)
    assert {(r.code, "".join(r.chain)) for r in found.collect()} == {
        ("circular_reference", "raba"), ("circular_reference", "rxx"), ("dangling_reference", "rxgone"),
        ("depth_exceeded", "rabcde"),
    }
    sound = edges.where("src IN ('s', 't')")
    assert gr.reference_chains(roots, sound, nodes, 4).count() == 0


def test_lineage(spark):
    rows = [("r0", None, None, None), ("r1", "r0", "q1", "f1"), ("r2", "r1", "q2", "f2"), ("r3", "r2", "q3", "f3"), ("r4", "r3", "q4", "f4"), ("x", "r1", "q1", "f9"), ("y", "r2", "q9", "f1")]
    df = spark.createDataFrame(rows, "run_id string, parent_run_id string, request_id string, fingerprint string")
    got = {r.run_id: r.status for r in gr.lineage_chain(df).collect()}
    assert got == {"r0": "accepted", "r1": "accepted", "r2": "accepted", "r3": "accepted", "r4": "decision_depth_exceeded", "x": "decision_replayed", "y": "decision_replayed"}


def test_shared_terms_of_small_and_large_items(spark):
    draw = random.Random(4)
    words = [f"w{n}" for n in range(400)]
    items = [(f"i{n:03d}", f"p{n % 2}", draw.sample(words, draw.randint(0, 9))) for n in range(120)]
    items += [(f"big{n}", "p0", draw.sample(words, 60)) for n in range(3)]
    items += [("long1", "p2", [f"t{n}" for n in range(5_000)]), ("long2", "p2", [f"t{n}" for n in range(5_000)])]
    items += [("near", "p2", ["t1", "t2", "x"]), ("far", "p2", ["t1", "y"])]
    table = spark.createDataFrame(items, "item string, place string, terms array<string>")
    groups = {i: {i} for i, _, _ in items}
    for a, place, terms in items:
        for b, other, more in items:
            if place == other and a < b and len(set(terms) & set(more)) >= 2 and groups[a] is not groups[b]:
                groups[a] |= groups[b]
                for member in groups[b]:
                    groups[member] = groups[a]
    want = {i: min(g) for i, g in groups.items() if len(g) > 1}
    for large in (16, 64):
        found = gr.connected_components(cl.shared_term_edges(table, large=large)).collect()
        assert {r.node: r.component for r in found} == want


def test_clusters(spark):
    rows = [
        ("f", "a1", ["Rules"], 0, "- Same.\n", "same.", False), ("f", "a2", ["Rules"], 9, "- Same.\n", "same.", False), ("f", "a3", ["Rules"], 18, "- Same.\n", "same.", True),
        ("f", "b1", ["Rules"], 30, "- Merge branches unless reviewers object.", "merge branches unless reviewers object.", False),
        ("f", "b2", ["Rules"], 60, "- Merge quickly except branches locked.", "merge quickly except branches locked.", False),
        ("f", "b3", ["Rules"], 90, "- Locked doors except quickly opened.", "locked doors except quickly opened.", False),
        ("f", "b4", ["Rules"], 99, "- Solitary except nothing.", "solitary except nothing.", False),
        ("g", "b5", ["Rules"], 9, "- Merge branches except nothing.", "merge branches except nothing.", False),
    ]
    df = spark.createDataFrame(rows, "doc string, block_id string, heading_path array<string>, start int, raw string, normalized string, protected boolean")
    overlaps = spark.createDataFrame([("a1", "e1", ["x", "y"]), ("a1", "e2", ["x", "X"]), ("a2", "e1", ["x", "y"])], "block_id string, event_id string, shared_terms array<string>")
    summaries, members, evidence = cl.derive_clusters(df, overlaps)
    found = {r.reason: r for r in summaries.collect()}
    assert found["exact_duplicate"].members == 2 and found["exact_duplicate"].importance == 88 and found["exact_duplicate"].evidence == 1
    assert found["exception_lineage"].members == 3 and found["exception_lineage"].importance == 60
    got = {}
    for r in members.collect():
        got.setdefault(r.cluster_id, set()).add(r.block_id)
    assert sorted(map(sorted, got.values())) == [["a1", "a2"], ["b1", "b2", "b3"]]
    noms = spark.createDataFrame([("n1", "mutable_candidate", "contradiction", ["b3", "b4"], ["e7"])], "nomination_id string, admission string, candidate_class string, source_ids array<string>, evidence_ids array<string>")
    extra = cl.nomination_clusters(noms, df)
    base = summaries.select("cluster_id", "first_block", "reason", "importance", "doc", "heading_path")
    merged, rows_, _ = cl.merge_overlapping(base.unionByName(extra[0]), members.select("cluster_id", "block_id").unionByName(extra[1]), evidence.unionByName(extra[2]), df)
    by_size = {r.members: (r.reason_codes, r.importance) for r in merged.collect()}
    assert by_size == {2: (["exact_duplicate"], 92), 4: (["exception_lineage", "semantic_contradiction"], 79)}
    assert cl.boundary_violations(merged, rows_, df).count() == 0
    summary = cl.candidate_summary(merged).first()
    assert (summary.status, summary.semantic, summary.clusters) == ("defects_detected", True, 2)


def test_component_rounds_keep_small_size_estimates(spark):
    # Scattered numbers along a chain and a star around its largest node: many rounds of joins.
    chain = [(n * 7919 % 3001, (n + 1) * 7919 % 3001) for n in range(3000)]
    star = [(9000, 4000 + n) for n in range(3000)]
    edges = spark.createDataFrame(chain + star, "a int, b int")
    found = gr.connected_components(edges)
    guessed = found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert guessed.bit_length() < 200
    assert {(r.component, r.n) for r in found.groupBy("component").agg(F.count("*").alias("n")).collect()} == {
        (0, 3001), (4000, 3001),
    }


def test_components_against_brute_force(spark):
    import random

    rng = random.Random(1)
    pairs = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(80)] + [(200, i) for i in range(201, 260)] + [(i, i + 1) for i in range(300, 330)]
    parent = {}
    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in pairs:
        if a != b:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    want = {n: find(n) for n in parent if any(n in p and p[0] != p[1] for p in pairs)}
    got = gr.connected_components(spark.createDataFrame(pairs, "a int, b int"))
    assert {r.node: r.component for r in got.collect()} == want


def test_runs(spark):
    targets = spark.createDataFrame([("a", True, True, "p", "q"), ("b", True, True, "p", "q"), ("c", True, True, "p", "q"), ("d", False, True, "p", "q"), ("e", False, True, "p", "q")], "doc string, existed boolean, changed boolean, pre_sha256 string, post_sha256 string")
    live = spark.createDataFrame([("a", "q"), ("b", "p"), ("c", "z"), ("d", "q")], "doc string, live_sha256 string")
    got = {r.doc: (r.status, r.needs_force, r.result_sha256) for r in rn.restore_plan(targets, live, ["doc"]).collect()}
    assert got == {"a": ("restorable", False, "p"), "b": ("already_restored", True, "p"), "c": ("diverged", True, "p"), "d": ("removable", False, None), "e": ("already_restored", True, None)}
    recovering = {r.doc: r.needs_force for r in rn.restore_plan(targets, live, ["doc"], recover=True).collect()}
    assert recovering == {"a": False, "b": False, "c": True, "d": False, "e": False}
    runs = spark.createDataFrame([("1", "applied"), ("2", "restored"), ("3", "planned")], "run_id string, state string")
    asked = runs.select("run_id")
    left, stones = rn.purge(runs, asked)
    assert {r.run_id for r in left.collect()} == {"1"} and {r.previous_state for r in stones.collect()} == {"restored", "planned"}
    assert rn.purge(runs, asked, force=True)[0].count() == 0
    work = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "cache_key string")
    cache = spark.createDataFrame([("k1", "r1"), ("k2", "r2")], "cache_key string, response string").withColumn(
        "response_sha256", F.when(F.col("cache_key") == "k1", content_sha("response")).otherwise("bad")
    )
    reuse, todo, corrupt = rn.cache_lookup(work, cache)
    assert [[r.cache_key for r in x.collect()] for x in (reuse, todo, corrupt)] == [["k1"], ["k3"], ["k2"]]


def test_gates_are_strict(spark):
    rows = [("a", "x" * 100, "x" * 40), ("b", "x" * 100, "x" * 39), ("c", "x" * 100, "x" * 4196), ("d", "x" * 100, "x" * 4197), ("e", "x", " "), ("f", "", "new"), ("g", "x" * 50, "password=abcdefghijk" + "x" * 20)]
    df = spark.createDataFrame(rows, "doc string, pre string, post string")
    got = {r.doc: r.code for r in mt.document_gates(df).collect()}
    assert got == {"a": None, "b": "size_ratio", "c": None, "d": "size_ratio", "e": "empty_target", "f": None, "g": "secret_in_proposal"}
    sizes = spark.createDataFrame([(60,), (40,)], "bytes long")
    assert mt.byte_budget(sizes, F.lit(True), 100).first().status == "within_budget"
    assert mt.byte_budget(sizes, F.lit(True), 99).first().status == "instruction_budget"
    runs = spark.createDataFrame([(1, 1, 1, 0, 1, 0), (2, 10, 10, 0, 7, 0), (3, 10, 10, 0, 6, 0), (4, 5, 6, 0, 1, 0), (5, 5, 6, 1, 1, 0), (6, 5, 5, 0, 1, 1)], "run_id int, pre_blocks int, post_blocks int, introductions int, changed int, confirmed_left int")
    assert {r.run_id: r.code for r in mt.run_gates(runs).collect()} == {1: None, 2: "excessive_churn", 3: None, 4: "directive_count_growth", 5: None, 6: "non_idempotent_proposal"}


def test_packing_drops_the_lowest_ranks(spark):
    rows = [("g", i, 10, i == 5) for i in range(6)] + [("h", 0, 99, True)]
    df = spark.createDataFrame(rows, "g string, rank int, cost int, required boolean")
    got = mt.pack_budget(df, ["g"], ["rank"], F.col("cost"), 40, F.col("required"))
    assert sorted(r.rank for r in got.where("g = 'g' and kept").collect()) == [0, 1, 2, 5]
    assert got.where("over_budget").select("g").distinct().collect()[0].g == "h"


def test_contained_phrases_without_a_broadcast(spark, monkeypatch):
    texts = [(i, f"the quick fox number {i} jumps over it") for i in range(200)] + [(900, None), (901, "")]
    phrases = [(i, f"fox number {i} jumps") for i in range(0, 400, 3)] + [(500, "quick fox"), (501, ""), (502, None)]
    table = spark.createDataFrame(texts, "text_id int, text string")
    listed = spark.createDataFrame(phrases, "phrase_id int, phrase string")
    want = {(t, p) for t, a in texts for p, b in phrases if a and b and b in a}
    for most in (0, 64 << 20):
        monkeypatch.setattr(su, "BROADCAST_BYTES", most)
        assert {(r.text_id, r.phrase_id) for r in su.contained_phrases(table, listed).collect()} == want


def test_coverage_without_selectors(spark):
    blocks = spark.createDataFrame([("/a/x.md", ["Top"]), (None, ["Top"])], "doc string, heading_path array<string>")
    selectors = spark.createDataFrame([(None, "*"), ("", "nowhere")], "suffix string, contained string")
    for listed in (selectors, selectors.limit(0)):
        assert su.coverage_gaps(blocks, listed).count() == 2
    everything = spark.createDataFrame([("", "*")], "suffix string, contained string")
    assert [r.doc for r in su.coverage_gaps(blocks, everything).collect()] == [None]


def test_structural_collisions_brute_force(spark):
    import random
    import re
    from itertools import product

    from evidgrid import lexicon as lx

    def found(pattern, text):
        return re.search(pattern.replace("(?iU)", "(?i)"), text) is not None

    def terms(text):
        words = re.findall("[a-z0-9][a-z0-9_-]*", text.lower())
        return {lx.DECISION_FAMILIES.get(w, w) for w in words if len(w) >= 3 and w not in lx.DECISION_STOP}

    def collides(a, b, texts):
        rows = []
        for text in filter(None, texts):
            negative, positive = found(lx.DECISION_NEGATIVE_PATTERN, text), found(lx.DECISION_POSITIVE_PATTERN, text)
            rows.append((terms(text), -1 if negative else int(positive), found(lx.DECISION_EXCLUSIVE_PATTERN, text), found(lx.DECISION_INCOMPATIBLE_PATTERN, text)))
        if not any(t & a for t, *_ in rows) or not any(t & b for t, *_ in rows):
            return False
        if any(stated and t & a and t & b for t, _, _, stated in rows):
            return True
        return any(
            len(x & y & (a | b)) >= 2 and ((s == 1 and r == -1) or (only and not x <= y and not y <= x))
            for (x, s, only, _), (y, r, _, _) in product(rows, rows)
        )

    draw = random.Random(5)
    vocabulary = "red blue green metal wood stone glass paper iron".split()
    marks = ["only", "never", "use", "versus", "", "", "", "", "", "", ""]
    conflicts, texts = [], []
    for number in range(150):
        conflicts.append((number, "red blue", "green metal"))
        for i in range(draw.randint(0, 4)):
            words = draw.sample(vocabulary, draw.randint(2, 5)) + [draw.choice(marks)]
            texts.append((number, f"t{i}", draw.choice([" ".join(words)] * 12 + [None, ""])))
    ground = spark.createDataFrame(texts + texts[:20], "conflict_id int, text_id string, text string")
    table = spark.createDataFrame(conflicts, "conflict_id int, subject_a string, subject_b string")
    got = {r.conflict_id: r.collides for r in ru.structural_collisions(table, ground).collect()}
    want = {
        n: collides(terms(a), terms(b), [t for m, _, t in texts if m == n]) for n, a, b in conflicts
    }
    assert got == want
    assert 10 < sum(want.values()) < 140
