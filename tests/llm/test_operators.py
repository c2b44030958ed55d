"""Corpus operators against brute force, round trips and held-out accuracy, and on awkward tables."""

import collections
import hashlib
import html as H
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelstone.llm import ann, boosting, chat_format, decontamination, html_extract, ngram_jaccard, packing, substring_dedup, token_counts, toxicity, url_filter
from keelstone.llm.components import connected
from keelstone.llm.queries import HARD_TEXT, ORACLE_SQL, QUERIES, URL_RULES
from tests.oracle import connect, same_rows

FEW = settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
DOCS = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long").add("k1", "string").add("part", "string").add("n_words", "string").add("score", "string")
LONG = " ".join(f"w{i}" for i in range(30_000))


def docs(spark, texts, ids=None):
    """A documents table with columns whose names operators use themselves."""
    return spark.createDataFrame([(i if ids is None else ids[i], t, None, "s", None, "clash", "clash", "clash", "clash") for i, t in enumerate(texts)], DOCS)


AWKWARD = [None, "", "   ", "one", "one two", "one two", "one two", "a b c d e f g", "A B C D E F G", "a b c d e f g", LONG, LONG + " more", "ÄÖ é é", "x" * 200_000, "  a\tb\nc  "]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, sf_dir, con, name):
    assert same_rows(QUERIES[name](spark, sf_dir), con, ORACLE_SQL[name]) is None


# -- URL filter ----------------------------------------------------------------------------

URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.net/en/a", "https://a.b.example.net/en/", "http://example.net/fr/", "http://example.net", "http://x.org/fr/1?q", "http://x.org/frx", "http://example.com/de/#f", "http://notexample.com/de/", "a://b://c.net/x", "http://net/x", "http://n.e.t/", "http://example.net?x=/en/", "http://example.com/de"]


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p) for h, p, _ in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "own", "own") for i, u in enumerate(URLS + URLS)], "page_id long, url string, rule string, block string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_filter.url_filter(pages, rules).collect()}
    assert got == {i: brute_rule(u) for i, u in enumerate(URLS + URLS)}
    none = url_filter.url_filter(pages, rules.limit(0))
    assert {r["verdict"] for r in none.collect()} == {"allow"} and none.count() == 2 * len(URLS)
    assert url_filter.url_filter(pages.limit(0), rules).count() == 0


def test_url_filter_joined_by_block_and_odd_rules(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_BLOCKS", 0)
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    rules = spark.createDataFrame([(f"h{i}.com", f"/p{i}", "block") for i in range(300)] + [("h1.com", "/p1", "allow"), (None, "/", "block"), ("h2.com", None, "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, f"http://www.h{i}.com/p{i}x/y") for i in range(400)] + [(900, "http://h2.com/zzz")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.url_filter(pages, rules).collect()}
    assert got[1] == ("h1.com/p1", "block") and got[2] == ("h2.com/p2", "block") and got[900] == ("h2.com", "allow") and got[350] == (None, "allow")
    assert sum(v == "block" for _, v in got.values()) == 300


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks, n = url_filter.bloom_blocks(keys, "key", 2000)
    assert url_filter.possible(keys, "key", blocks, n).count() == 2000
    assert url_filter.possible(spark.range(20000).select(F.concat(F.lit("q"), "id").alias("key")), "key", blocks, n).count() < 400


# -- n-gram Jaccard ------------------------------------------------------------------------


def brute_components(texts, k, num, den):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_jaccard_on_awkward_documents(spark):
    got = ngram_jaccard.ngram_jaccard(docs(spark, AWKWARD), k=4, num=85, den=100).collect()
    want = brute_components(AWKWARD, 4, 85, 100)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(i, *w) for i, w in enumerate(want)]


def test_jaccard_empty_table_and_repeated_rows(spark):
    assert ngram_jaccard.ngram_jaccard(docs(spark, [])).count() == 0
    got = ngram_jaccard.ngram_jaccard(docs(spark, ["a b c d e f", "a b c d e f", "a b c d e f", "q"], [5, 5, None, 7])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in got) == [(-1, 5), (5, 5), (5, 5), (7, 7)]


def altered(seed, n, copies, edits):
    rng = np.random.default_rng(seed)
    base = [f"v{rng.integers(5000)}" for _ in range(n)]
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.integers(0, edits + 1)):
            w[rng.integers(len(w))] = f"e{rng.integers(9)}"
        out.append(" ".join(w[: len(w) - rng.integers(0, 4)]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_near_copies(spark, seed, monkeypatch):
    texts = altered(seed, 60, 40, 3) + altered(seed + 10, 25, 25, 2) + altered(seed + 20, 120, 20, 8) + [f"z{i} y{i} x{i} w{i} v{i}" for i in range(10)]
    want = brute_components(texts, 4, 85, 100)
    for hubs in ((2, 64, None), (1, None), (None,)):
        monkeypatch.setattr(ngram_jaccard, "HUBS", hubs)
        got = ngram_jaccard.ngram_jaccard(docs(spark, texts), k=4, num=85, den=100).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(i, *w) for i, w in enumerate(want)]


def test_jaccard_five_words(spark):
    texts = altered(5, 80, 30, 4)
    got = ngram_jaccard.ngram_jaccard(docs(spark, texts)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(i, *w) for i, w in enumerate(brute_components(texts, 5, 4, 5))]


@FEW
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=15))
def test_connected_components(spark, links):
    root = list(range(13))
    for _ in range(13):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(links, "a long, b long")
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {r["node"]: r["root"] for r in connected(df).collect()} == {i: root[i] for i in linked}


# -- substring dedup -----------------------------------------------------------------------


def brute_cut(texts, width):
    words = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()) for t in texts]
    seen = collections.Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


@pytest.mark.parametrize("width", [35, 4, 5, 1])
def test_substring_dedup(spark, width):
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(50)]
    texts = list(AWKWARD)
    for _ in range(25):
        w = [f"u{rng.integers(10**6)}" for _ in range(rng.integers(0, 90))]
        at = rng.integers(0, len(w) + 1)
        a = rng.integers(0, 20)
        texts.append(" ".join(w[:at] + passage[a : a + rng.integers(30, 50)] + w[at:]))
    texts.append(" ".join(["r"] * 80))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.substring_dedup(docs(spark, texts), width=width).collect()}
    assert got == dict(enumerate(brute_cut(texts, width)))


def test_substring_dedup_spans_and_empty(spark):
    text = " ".join(f"a{i}" for i in range(40))
    d = docs(spark, [f"x {text} y", f"z z2 {text}"])
    spans = substring_dedup.repeat_classes(d, width=35).select("spans").collect()
    assert sorted((s["start"], s["length"]) for r in spans for s in r["spans"]) == [(1, 40), (2, 40)]
    out = substring_dedup.substring_dedup(docs(spark, []))
    assert out.count() == 0 and set(DOCS.names) <= set(out.columns)


# -- toxicity ------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scored = QUERIES["op3_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    rank = scored.score.rank()
    pos = scored.toxic == 1
    area = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert area > 0.95 and (scored.predicted == scored.toxic).mean() > 0.95


def test_toxicity_on_awkward_tables(spark):
    d = docs(spark, AWKWARD)
    model = toxicity.fit_toxicity(d, spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.score_toxicity(d, model)
    assert got.count() == len(AWKWARD) and set(got.columns) == set(DOCS.names)
    texts = [f"you are a stupid idiot number {i}" if i % 3 == 0 else f"a calm sentence number {i}" for i in range(200)] + [None, ""]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), None) for i in range(200)] + [(None, 1, None), (5, None, None), (7, 0, None), (999, 1, None)], "doc_id long, toxic int, text string")
    scores = {r["doc_id"]: float(r["score"]) for r in toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels)).collect()}
    assert all((s >= 0.5) == (i % 3 == 0 and i < 200) for i, s in scores.items())
    assert all(0 <= s <= 1 for s in scores.values())
    assert toxicity.score_toxicity(docs(spark, []), model).count() == 0


def test_features_see_obfuscation_and_the_second_person():
    f = toxicity.Featurizer({"zorp": 3.0, "blar*": 2.0})
    plain, bad = f("a calm day"), f("You id1ot, you zorp! blarxy")
    assert len(plain) == toxicity._N_FEATURES
    assert bad[21] > 0 and bad[12] > 0 and bad[8] == 3.0 and bad[5] > 0 and not any(plain[i] for i in (2, 4, 6, 9, 13, 21))


def test_isotonic_and_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0) & (x[:, 1] > -0.5)).astype(float)
    raw = boosting.BoostedTrees(rounds=40).fit(x, y).raw(x)
    assert ((raw > 0) == (y == 1)).mean() > 0.97
    xs, ys = boosting.isotonic(raw, y)
    assert (np.diff(ys) > 0).all() and (np.diff(xs) >= 0).all() and 0 <= ys.min() <= ys.max() <= 1


# -- packing and token counts --------------------------------------------------------------

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    from tokenizers import Tokenizer

    return np.array(Tokenizer.from_file(WORD_BPE).encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")


def check_packed(rows, texts, capacity):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert len(by_doc) == len(texts)
    for i, pieces in by_doc.items():
        ids, at = ids_of(texts[i]), 0
        for p in sorted(pieces, key=lambda r: r["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    return len(by_seq)


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(spark, capacity):
    texts = AWKWARD[:13] + AWKWARD[14:] + ["<|endoftext|> İSTANBUL don't x\u00a0y\u2003z ﬁ", "e\u0301 \u0301 a\x1cb ΣΑΣ"] + [" ".join(f"w{i}x{j}" for j in range(i)) for i in range(60)]
    rows = packing.pack(docs(spark, texts), WORD_BPE, capacity).collect()
    n = check_packed(rows, texts, capacity)
    total = sum(r["length"] for r in rows)
    assert n * capacity - total < 2 * capacity
    assert packing.pack(docs(spark, []), WORD_BPE).count() == 0


@FEW
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 9), max_size=12))
def test_fill_plan_uses_everything_and_fits(counts):
    used = collections.Counter()
    for times, pattern in packing.fill_plan(counts, 64):
        assert times > 0 and sum(n * c for n, c in pattern.items()) <= 64
        for n, c in pattern.items():
            used[n] += times * c
    assert used == collections.Counter(counts)


def test_first_window_is_filled_as_well_as_can_be():
    (times, pattern), *_ = packing.fill_plan({50: 1, 9: 1, 7: 1, 5: 1}, 64)
    assert (times, pattern) == (1, {50: 1, 9: 1, 5: 1})


def test_token_counts(spark):
    texts = [t for t in AWKWARD if t is None or len(t) < 1000] + ["a\n\n\nb  \n c\nÄÖ\n"]
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    enc, _ = token_counts._encoding(path, pattern)
    for rule in token_counts.RULES:
        for r in token_counts.token_counts(docs(spark, texts), path, pattern, ["source", "text"], rule=rule).collect():
            text = "s" + (texts[r["doc_id"]] or "")
            ids = enc.encode_ordinary(text)
            assert r["n_tokens"] == len(ids) == sum(r["section_tokens"]) == sum(r["field_tokens"])
            lines = ["s", *(texts[r["doc_id"]] or "").splitlines(keepends=True)] if texts[r["doc_id"]] else ["s"]
            assert len(r["section_tokens"]) == len(lines)
            ends = np.cumsum([len(x.encode()) for x in lines])
            at, want = 0, [0] * len(lines)
            for i in ids:
                piece = enc.decode_single_token_bytes(i)
                a, b = at, at + len(piece)
                first, last = (int(np.searchsorted(ends, x, side="right")) for x in (a, b - 1))
                held = [min(b, ends[s]) - max(a, ends[s - 1] if s else 0) for s in range(first, last + 1)]
                want[{"start": first, "end": last, "most": first + int(np.argmax(held))}[rule]] += 1
                at = b
            assert r["section_tokens"] == want
    assert token_counts.token_counts(docs(spark, []), path, pattern).count() == 0
    with pytest.raises(ValueError):
        token_counts.attribute(np.array([1]), np.array([0]), 1, "other")


# -- decontamination -----------------------------------------------------------------------


def brute_hits(texts, items, n):
    word = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
    low = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for t in texts:
        w = low(t)
        hit, found = set(), set()
        for item, text in items:
            x = low(text)
            for win in [x[i : i + n] for i in range(len(x) - n + 1)] if len(x) >= n else [x] if x else []:
                for i in range(len(w) - len(win) + 1):
                    if w[i : i + len(win)] == win:
                        hit |= set(range(i, i + len(win)))
                        if item is not None:
                            found.add(str(item))
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_decontamination(spark, monkeypatch):
    items = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "one two"), (3, "é"), (4, ""), (5, None), (None, "q r s"), (2, "x y z x y z x y z x y"), (10, "one two"), (11, "...")]
    texts = [t for t in AWKWARD if t is None or len(t) < 1000] + ["say ALPHA, beta gamma-delta epsilon zeta eta theta iota kappa lambda mu. one", "beta gamma delta epsilon zeta eta theta iota kappa lambda", "x y z " * 9, "q r s q r s", "One Two one, two É"]
    bench = spark.createDataFrame([(i, t, "own") for i, t in items], "item_id long, text string, window string")
    want = brute_hits(texts, items, 10)
    for block in (200_000, 2):
        monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", block)
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in decontamination.decontaminate(docs(spark, texts), bench).collect()}
        assert got == {i: w for i, w in enumerate(want)}
    assert decontamination.decontaminate(docs(spark, []), bench).count() == 0
    assert not decontamination.decontaminate(docs(spark, texts), bench.limit(0)).where("contaminated").count()


# -- HTML ----------------------------------------------------------------------------------


def extract(spark, pages, **options):
    df = spark.createDataFrame([(i, u, h, "own") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, page string")
    return {r["page_id"]: r["text"] for r in html_extract.extract_pages(df, **options).collect()}


PAGE = '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li>menu</li></ul></nav><!-- ad --><div class="ad">buy</div><article><h1>Head &amp; more</h1><p><b>First\n  one.<br><p>Second&nbsp;&lt;2&gt; <i>x</i></p><aside>side</aside><div class="comments"><p>reader</p></div><form><input>go</form><ul><li>a<li>b</ul></article><footer>&copy; f</footer>'


def test_html_blocks_and_boilerplate(spark):
    odd = ["", None, "plain text", "<p>a<p>b", "<div>x<b>y</div>z", "<article>", "</p></div>", "<p title='>'>q</p>", "<article><p>a &#x41;&eacute;&bogus;</p><!-- never closed <p>b", '<div id="sidebar">s</div><p>t', "<table><tr><td>1<td>2<tr><td>3</table>", "<p>" + "long word " * 50_000, "<" * 1000, "<p>1 < 2 and 3 > 2</p>", "<main><p>m</p></main><p>out</p>"]
    got = extract(spark, [("http://h/", PAGE)] + [(None, x) for x in odd])
    assert got[0] == "Head & more\n\nFirst one.\n\nSecond <2> x\n\na\n\nb"
    assert [got[i + 1] for i in (0, 1, 2, 3, 4, 5, 6, 7)] == ["", "", "plain text", "a\n\nb", "xy\n\nz", "", "", "q"]
    assert got[9] == "a Aé&bogus;" and got[10] == "t" and got[11] == "1 2\n\n3" and len(got[12]) == 499_999 and got[14] == "1 < 2 and 3 > 2" and got[15] == "m"


def test_html_site_template(spark):
    def page(i, own):
        return f"<html><body><div><p>Our site</p><p>links</p></div><div><p>story {own} with enough text to be the most of the page</p></div><div>Tail {i % 2}</div></body></html>"

    pages = [("http://a.com/", page(i, f"number {i}")) for i in range(12)] + [("http://b.com/", page(0, "only here"))] + [("http://c.com/", page(0, "the same"))] * 9
    for bound in (1_000_000, 0):  # broadcast, and joined to the pages
        got = extract(spark, pages, broadcast_subtrees=bound)
        assert got[0] == "story number 0 with enough text to be the most of the page"
        assert "Our site" in got[12] and "Our site" in got[13]  # too few pages, and one page many times
    shared = [("http://d.com/", f"<article><p>shared passage</p><p>own {i} text</p></article>") for i in range(9)]
    assert extract(spark, shared)[0] == "shared passage\n\nown 0 text"


def test_html_on_the_table(spark, sf_dir):
    got = QUERIES["op7_html_extraction"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in got:
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        want = [" ".join(H.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"<(?:p|/p|h1|/h1)>", body)]
        assert r["text"] == "\n\n".join(x for x in want if x) and r["n_chars"] == len(r["text"])


# -- chat ----------------------------------------------------------------------------------

TRICKY = st.lists(st.sampled_from(["\\", "<", "/", "turn", ">", " ", "-", "g", "t", "</turn>", "<turn ", "\n", "é", "#", "|", "<\\/turn>", "\\\\"]), max_size=8).map("".join)


@FEW
@given(st.lists(st.lists(st.tuples(TRICKY, TRICKY), min_size=1, max_size=4), min_size=1, max_size=30))
def test_chat_round_trip(spark, convs):
    rows = [(c, t, r, x) for c, turns in enumerate(convs) for t, (r, x) in enumerate(turns)]
    out = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), ("g",))
    for r in out.withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))).collect():
        turns = convs[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert r["loss"] == "".join(x for role, x in turns if role == "g")
        assert r["formatted"].count("</turn>") == r["formatted"].count("<turn ") == len(turns)


def test_chat_awkward_tables(spark):
    schema = "conv_id long, turn long, role string, text string, turns string, source string"
    rows = [(1, 1, None, None, "c", "c"), (1, 0, "user", HARD_TEXT, "c", "c"), (1, 0, "user", HARD_TEXT, "c", "c"), (1, None, "a", "first", "c", "c"), (None, 0, "assistant", "x", "c", "c"), (2, 0, "assistant", "y" * 300_000, "c", "c")]
    got = {r["conv_id"]: r for r in chat_format.format_conversations(spark.createDataFrame(rows, schema)).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("a", "first"), ("user", HARD_TEXT), ("user", HARD_TEXT), ("", "")]
    assert got[None]["loss_spans"][0]["length"] == 1 and got[2]["loss_spans"][0]["length"] == 300_000
    assert chat_format.format_conversations(spark.createDataFrame([], schema)).count() == 0


# -- nearest neighbours --------------------------------------------------------------------


def brute_nearest(ids, x, q, k):
    s = (x * x[ids.index(q)]).sum(axis=1)
    return [(-a, i) for a, i in sorted((-v, i) for v, i in zip(s, ids, strict=True) if i != q)[:k]]


def test_ann_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(20, size=3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32).astype(float)
    x[100:160] = x[100]  # one vector many times
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.ann_search(df, df.where("vec_id % 20 = 0"), 20).toPandas()
    right = total = 0
    ids = list(range(3000))
    for q, rows in found.sort_values("rank").groupby("query_id"):
        want = brute_nearest(ids, x, q, 20)
        right += len({i for _, i in want} & set(rows.vec_id))
        total += 20
        assert list(rows["rank"]) == list(range(1, 21)) and q not in set(rows.vec_id)
        assert np.allclose(rows.score, [(x[q] * x[i]).sum() for i in rows.vec_id], rtol=0, atol=1e-12)
        assert list(zip(-rows.score, rows.vec_id, strict=True)) == sorted(zip(-rows.score, rows.vec_id, strict=True))
    assert total == 3000 and right / total >= 0.95


def test_ann_shards_of_large_leaves(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 8)
    monkeypatch.setattr(ann, "LEAF_ROWS", 40)
    x = np.random.default_rng(5).integers(-3, 4, (300, 4)).astype(float)
    x[:, 0] += 0.5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.ann_search(df, df.where("vec_id % 20 = 0"), 5, target=1.0).toPandas()
    for q, rows in got.sort_values("rank").groupby("query_id"):
        assert list(rows.vec_id) == [i for _, i in brute_nearest(list(range(300)), x, q, 5)]


def test_ann_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [1.0]), (None, [1.0, 1.0]), (40, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("leaf", F.lit(1))
    got = ann.ann_search(df, df.where("vec_id % 20 = 0"), 20).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 7, 1.0), (0, 2, 8, 1.0), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 7, 0.5), (20, 3, 8, 0.5)]
    assert ann.ann_search(df.limit(0), df).count() == 0 and ann.ann_search(df, df.limit(0)).count() == 0


def test_every_query_has_its_contract_columns(spark, sf_dir):
    want = {
        "op2_ngram_jaccard": "doc_id n_shingles component_id", "op3_toxicity": "doc_id held_out score predicted", "op4_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        "op10_substring_dedup": "doc_id n_words n_removed kept_sha256", "op9_ann": "query_id rank vec_id score",
    }
    for name, cols in want.items():
        assert QUERIES[name](spark, sf_dir).columns == cols.split()
    got = {r["doc_id"]: r["kept_sha256"] for r in QUERIES["op10_substring_dedup"](spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    kept = dict(zip(texts, brute_cut(list(texts.values()), 35), strict=True))
    assert got == {i: hashlib.sha256(kept[i][2].encode()).hexdigest() for i in texts}
