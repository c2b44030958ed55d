"""Sources, store, vectors, graph, linking, extraction and streaming on small fixtures."""

import itertools

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keelstone.functions import text as X
from keelstone.functions.markup import event_text
from keelstone.operators import extract, graph, linking, store, vectors
from keelstone.plans import validation
from keelstone.schemas import RULE, with_defaults
from keelstone.sources import files, toml

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
COLLECTION = """
[[rules]]
id = "r1"
content = "Division needs a divisor that is not zero"
formal_spec = '''b =/= 0'''
depends_on = ["r2", "gone"]
error_codes = ["CEMX1"]
layer = "library"

[[rules]]
id = "r2"
content = "Integer division by zero is undefined"
formal_spec = "x"
tags = ["a", "b"]

[[error_codes]]
code = "UB-CEMX1"
internal_code = "CEMX1"
type = "undefined_behavior"
description = "Division by zero"
"""


def test_toml_collection(spark, tmp_path):
    path = tmp_path / "rules.toml"
    path.write_text(COLLECTION)
    rules = toml.read_rules(spark, str(path))
    rows = {r["id"]: r for r in rules.collect()}
    assert rows["r1"]["depends_on"] == ["r2", "gone"] and rows["r1"]["violated_by"][0]["error_type"] == "UNDEF"
    assert (rows["r2"]["layer"], rows["r2"]["confidence"], rows["r2"]["tags"]) == ("c11_core", 1.0, ["a", "b"])
    spark.dataSource.register(toml.TomlRules)
    read = spark.read.format("toml_rules").load(f"{path},{tmp_path}/missing.toml")
    assert {r["id"] for r in read.collect()} == {"r1", "r2"}
    codes = toml.read_rules(spark, str(path), "error_codes")
    loaded = validation.load_collection(rules, codes)
    assert [tuple(r) for r in loaded["depends_on"].collect()] == [("r1", "r2")]
    assert [tuple(r) for r in loaded["violated_by"].collect()] == [("r1", "CEMX1")]
    assert [r["dst"] for r in loaded["dangling"].collect()] == ["gone"]
    assert loaded["rules"].count() == 2


def test_pairing_manifest():
    pairs, idioms = toml.parse_pairings('[[pairing]]\nopener = "a"\ncloser = "b"\n[[idiom]]\nname = "scope"\nparticipants = ["a"]\n')
    assert pairs[0]["required"] is True and pairs[0]["confidence"] == 1.0 and idioms[0]["id"] == "idiom_scope"


@FEW
@given(st.text(alphabet="ab'\"\\\n é", min_size=1, max_size=20))
def test_toml_strings_round_trip(spark, value):
    df = spark.createDataFrame([("i", value, "s")], "id string, content string, formal_spec string")
    text = df.select(toml.toml_record({c: (F.col(c), "") for c in df.columns})).first()[0]
    back = toml.parse_rules(text)[0]["content"]
    assert back == (value[1:] if value.startswith("\n") and "'''" not in value and not value.endswith("'") else value)


def test_defaults(spark):
    row = with_defaults(spark.createDataFrame([("a", None)], "id string, confidence double")).first()
    assert (row["layer"], row["confidence"], row["tags"], row["reviewed"]) == ("c11_core", 1.0, [], False)
    assert len(row) == len(RULE)


def test_error_catalogue(spark):
    rows = [("Code", "Description", "Refs", "Type"), ("UB-X1", " bad ", "6.5, 6.6", "Undefined"), ("IMPL-Y", "i", "", "Implementation defined"), ("CV-Z", "c", None, "Constraint violation"), ("UB-short", None, None, None)]
    got = {r["code"]: r for r in files.error_catalogue(spark.createDataFrame(rows, "c0 string, c1 string, c2 string, c3 string")).collect()}
    assert set(got) == {"UB-X1", "IMPL-Y", "CV-Z"}
    assert got["UB-X1"]["internal_code"] == "X1" and got["UB-X1"]["std_refs"] == ["6.5", "6.6"] and got["IMPL-Y"]["type"] == "implementation_defined"


def test_sessions_skip_corrupt_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"session_id": "s", "n": 1}')
    (tmp_path / "b.json").write_text("{broken")
    assert [r["session_id"] for r in files.read_sessions(spark, str(tmp_path), "session_id string, n int").collect()] == ["s"]


@FEW
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9)), max_size=8), st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9)), max_size=8))
def test_upsert_like_a_dict_and_idempotent(spark, old, new):
    old = list(dict(old).items())
    a = spark.createDataFrame(old, "k int, v int").withColumn("ord", F.lit(0))
    b = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(new)], "k int, v int, ord int")
    once = store.upsert(a, b, ["k"], ["ord"])
    assert {r["k"]: r["v"] for r in once.collect()} == {**dict(old), **dict(new)}
    assert sorted(map(tuple, store.upsert(once, b, ["k"], ["ord"]).collect())) == sorted(map(tuple, once.collect()))


def test_knn_is_the_prefix_of_a_full_sort(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (40, 3)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    want = {i: [j for _, j in sorted((round(float(((x[i] - x[j]) ** 2).sum()), 6), j) for j in range(40) if j != i)[:5]] for i in range(40)}
    for bound in (64_000_000, 100):  # one matrix, and many blocks
        monkeypatch.setattr(vectors, "BROADCAST_BYTES", bound)
        got = {}
        for r in vectors.knn(df, df, 5, "id", "v", skip_self=True).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        assert got == want


def test_near_duplicate_verdicts(spark):
    hits = spark.createDataFrame([(1, 0.05), (1, 0.3), (2, 0.3), (3, 9.0)], "query_id long, distance double")
    assert {r["query_id"]: (r["verdict"], r["similar"]) for r in vectors.near_duplicates(hits).collect()} == {1: ("duplicate", 0), 2: ("similar", 1), 3: ("unique", 0)}


@FEW
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=12))
def test_paths_are_simple_and_longest(spark, edges):
    e = spark.createDataFrame(edges, "src int, dst int")
    starts = spark.createDataFrame([(i,) for i in range(6)], "id int")
    best = {}
    for n in range(2, 6):
        for p in itertools.permutations(range(6), n):
            if all(x in set(edges) for x in itertools.pairwise(p)) and p[-1] in (4, 5):
                best[p[0]] = min(best.get(p[0], (0, [])), (-(n - 1), list(p)))
    got = {r["start"]: (-r["depth"], r["path"]) for r in graph.longest_paths(starts, e, spark.createDataFrame([(4,), (5,)], "id int"), 4).collect()}
    assert got == best


def test_pair_expansion_keeps_hits_once(spark):
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "query_id long, rank int, id string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "at string, other string")
    idioms = spark.createDataFrame([("a", "i"), ("b", "i")], "at string, idiom string")
    got = [(r["kind"], r["id"]) for r in vectors.expand_pairs(hits, pairs, idioms).orderBy("pos").collect()]
    assert got == [("hit", "a"), ("pair", "c"), ("idiom", "i"), ("hit", "b"), ("idiom", "i")]


def test_cell_pairings(spark):
    rows = [(0, "open", "c", "write"), (1, "close", "c", "remove"), (2, "edit", "c", "modify"), (3, "open", "d", "remove"), (4, "look", "c", "read")]
    got = {(r["opener"], r["closer"]): (r["required"], r["confidence"]) for r in linking.cell_pairings(spark.createDataFrame(rows, "ord int, function string, cell string, access string")).collect()}
    assert got == {("open", "close"): (True, 1.0), ("open", "edit"): (False, 0.8), ("edit", "close"): (False, 0.8)}


def test_name_and_static_pairings(spark):
    names = spark.createDataFrame([(n,) for n in ("a_lock", "a_unlock", "b_lock", "create_x", "destroy_x", "push_back", "pop_back")], "name string")
    assert {tuple(r) for r in linking.name_pairings(names).collect()} == {("a_lock", "a_unlock"), ("create_x", "destroy_x")}
    assert {tuple(r) for r in linking.static_pairings(names).collect()} == {("push_back", "pop_back")}


def test_cell_access_prefers_the_stronger_kind(spark):
    rule = "<mem> .Map => X </mem> <mem> Y </mem> <env> B |-> _ => .Map </env> <st> Z </st>"
    got = spark.createDataFrame([(rule,)], "t string").select(X.cell_access(F.col("t"))).first()[0]
    assert [(r["cell"], r["access"]) for r in got] == [("mem", "write"), ("env", "remove"), ("st", "read")]


def test_ignore_globs(spark):
    paths = ["build/a.c", "src/build/x.c", "src/a.o", "src/gen/b.c", "src/a.c"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", X.ignored(F.col("p"), ["build/", "*.o", "src/gen/*"]).alias("i"))
    assert {r["p"] for r in df.collect() if r["i"]} == {"build/a.c", "src/build/x.c", "src/a.o", "src/gen/b.c"}


def test_json_links_and_records(spark):
    df = spark.createDataFrame([('x ```json\n{"f": ["a", "b"], "n": 1}\n```',), ('so {"g": ["c"]} ok',), ("broken {",), ("",)], "t string")
    assert [r[0] for r in df.select(X.json_links(F.col("t"))).collect()] == [{"f": ["a", "b"]}, {"g": ["c"]}, {}, {}]
    got = spark.createDataFrame([('[{"content": "a"}, {"formal_spec": "x"}]',), ("no",)], "t string").select(X.json_records(F.col("t")).alias("r")).collect()
    assert [[x["content"] for x in r["r"]] for r in got] == [["a"], []]


def test_html_event_text():
    assert event_text("<nav>m</nav><h1>T</h1><p>a\n b</p><li>c</li><script>x</script><footer>f</footer>") == "## T\n\na b\n- c"


C_FILE = """
/* int hidden(void); */
#define SAFE_DIV(a, b) \\
    ((a) / (b))
#define LIMIT 10
// @rule:pairs_with release
// @rule:required false
int acquire(int n);

static int work(int *p, int n) {
    int q = n / 2;
    for (int i = 0; i < q; i++) { p[i] += 1; }
    if (p == 0) { return -1; } else { release(p, q); }
    s->count++;
    char *c = (char *)malloc(n * sizeof(int));
    delete c;
    return n > 3 ? q : *p;
}
"""


def test_c_extraction(spark):
    src = spark.createDataFrame([("w.c", C_FILE)], "path string, content string")
    ops = extract.operations(src).orderBy("ord").collect()
    kinds = [o["op_type"] for o in ops]
    for k in ("division", "loop", "array_access", "compound_assignment", "branch", "return", "function_call", "arrow_access", "increment", "cast", "multiplication", "sizeof", "delete", "ternary", "pointer_deref", "greater", "variable_decl"):
        assert k in kinds, k
    call = next(o for o in ops if o["function_called"] == "release")
    assert call["guards"] == ["!(p == 0)"] and call["call_arguments"] == ["p", "q"]
    profile = extract.profiles(extract.operations(src)).first()
    assert profile["has_hazard"] and profile["calls"] == ["release", "malloc"] and "release precondition semantics" in profile["queries"]
    macros = {m["name"]: m for m in extract.macros(src).collect()}
    assert macros["SAFE_DIV"]["params"] == ["a", "b"] and macros["SAFE_DIV"]["has_division"] and not macros["LIMIT"]["has_hazard"]
    pairs, idioms = extract.annotated_pairs(extract.annotations(src))
    assert [(r["opener_id"], r["closer_id"], r["required"]) for r in pairs.collect()] == [("rule_for_acquire", "rule_for_release", False)]
    assert idioms.count() == 0
    assert [s["name"] for s in extract.signatures(src).collect()] == ["acquire", "work"]


def test_rewrite_rules(spark):
    k = 'module LIBC-MEM\n/*@ \\fromStandard{\\source[n1570]{\\para{7.22}{2}}}{Frees memory.}*/\nrule free(P) => voidVal\n\nrule alloc(S) => X\n  requires S >Int 0\n    andBool isZero(S)\n\nrule bad(P) => UNDEF("E1", "Bad free")\nendmodule\n'
    blocks = extract.rule_blocks(spark.createDataFrame([("m.k", k)], "path string, content string"))
    rules = {r["function"]: r for r in extract.rules_from(extract.parsed_rules(blocks)).collect()}
    assert rules["free"]["rule_type"] == "postcondition" and rules["free"]["content"] == "Frees memory." and rules["free"]["std_ref"] == "7.22/2"
    assert rules["alloc"]["rule_type"] == "precondition" and rules["alloc"]["formal_spec"] == "S >Int 0 andBool isZero(S)" and rules["alloc"]["tags"][0] == "zero_check"
    assert rules["bad"]["rule_type"] == "constraint" and rules["bad"]["error_code"] == "E1"


RULES = [("r1", "Signed integer overflow is undefined behavior", "M", "c11_core", 1.0), ("r2", "Unsigned integer arithmetic wraps around", "M", "c11_core", 0.9), ("r3", "The lock must be released", "L", "library", 0.8)]


def test_validate_texts_and_stream(spark, tmp_path):
    rules = spark.createDataFrame(RULES, "id string, content string, module string, layer string, confidence double")
    edges = spark.createDataFrame([("r3", "r1")], "src string, dst string")
    texts = spark.createDataFrame([("t", "Signed integer overflow is safe. Unsigned integer arithmetic wraps around! The lock must be released")], "text_id string, text string")
    got = {r["place"]: r for r in validation.validate_texts(texts, rules, edges).collect()}
    assert not got[0]["is_valid"] and got[1]["is_valid"] and got[1]["confidence"] == 0.9
    assert got[2]["grounded"] and "involves security-sensitive operations" in got[0]["warnings"]
    from keelstone.streaming.claims import validate_stream

    source = tmp_path / "in"
    spark.createDataFrame([("c1", "Signed integer overflow is safe")], "claim_id string, claim string").write.parquet(str(source))
    seen = []
    q = validate_stream(spark.readStream.schema("claim_id string, claim string").parquet(str(source)), rules, lambda df, n: seen.extend(df.collect()), str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    assert [(r["claim_id"], r["is_valid"]) for r in seen] == [("c1", False)]


def test_entry_points():
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150


@pytest.mark.parametrize("name", ["entry"])
def test_entry(spark, name):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
