"""Column functions over text: polarity, topics, claims, identifiers, html, pattern tables.

All are compositions of built-in functions; lexicons are parameters.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelstone.functions import patterns as P


def _none() -> Column:
    return F.lit(None).cast("string")


def strip(c: Column) -> Column:
    """Without white space at both ends (not just spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def has_any(c: Column, words: Iterable[str]) -> Column:
    """Whether any of the words is a substring."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words], F.lit(False))


def matches_any(c: Column, regexes: Iterable[str]) -> Column:
    return c.rlike("|".join(f"(?:{r})" for r in regexes))


def labels(pairs: Iterable[tuple[str, Column]]) -> Column:
    """The labels whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]))


# -- claims and entailment -----------------------------------------------------------


def claims(text: Column, least: int = 10) -> Column:
    """The sentences of a text longer than ``least`` characters."""
    return F.filter(F.transform(F.split(text, r"[.!?]+"), strip), lambda s: F.length(s) > least)


def polarity(text: Column, positive: Sequence[str] = P.POSITIVE, negative: Sequence[str] = P.NEGATIVE) -> Column:
    """Negative words win over positive ones; case-insensitive substrings."""
    low = F.lower(text)
    return F.when(has_any(low, [w.lower() for w in negative]), "negative").when(has_any(low, [w.lower() for w in positive]), "positive").otherwise("neutral")


def lemmatise(text: Column, lemmas: Mapping[str, str] = P.LEMMAS) -> Column:
    return reduce(lambda c, x: F.regexp_replace(c, rf"(?i)\b{x[0]}\b", x[1]), lemmas.items(), text)


def topics(text: Column, table: Mapping[str, Sequence[str]] = P.TOPICS, lemmas: Mapping[str, str] = P.LEMMAS) -> Column:
    """The topics that a text is about, by regular expression after lemmatising."""
    plain = lemmatise(text, lemmas)
    return labels((name, plain.rlike("(?i)" + "|".join(f"(?:{r})" for r in regexes))) for name, regexes in table.items())


def rule_polarity(content: Column, module: Column, has_codes: Column | None = None, positive=P.POSITIVE, negative=P.NEGATIVE, implicit=P.IMPLICIT_ERRORS, marks=P.ERROR_MODULE_MARKS) -> Column:
    """A rule's polarity; error rules and terse error phrases are negative."""
    own = polarity(content, positive, negative)
    error = has_any(F.upper(F.coalesce(module, F.lit(""))), marks)
    if has_codes is not None:
        error = error | F.coalesce(has_codes, F.lit(False))
    return F.when(error, "negative").when((own == "neutral") & matches_any(F.lower(content), implicit), "negative").otherwise(own)


def entailment(claim_polarity: Column, rule_side: Column, shared_topics: Column) -> Column:
    """Relationship and confidence from polarities and the number of shared topics."""
    pair = lambda a, b: (claim_polarity == a) & (rule_side == b)
    table = [
        (shared_topics == 0, "RELATED_TO", 0.3), (pair("positive", "negative"), "CONTRADICTS", 0.9), (pair("negative", "negative"), "SUPPORTS", 0.8),
        (pair("positive", "positive"), "SUPPORTS", 0.7), (pair("negative", "positive"), "CONTRADICTS", 0.7),
    ]
    kind, sure = F.lit("RELATED_TO"), F.lit(0.5)
    for cond, k, c in reversed(table):
        kind, sure = F.when(cond, F.lit(k)).otherwise(kind), F.when(cond, F.lit(c)).otherwise(sure)
    return F.struct(kind.alias("relationship"), sure.alias("confidence"))


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def passes(distance: Column, claim: Column, content: Column, least: float = 0.4) -> Column:
    """Near enough, or without a distance two shared words."""
    words = lambda c: F.array_distinct(F.split(strip(F.lower(c)), r"\s+"))
    return F.when(distance.isNotNull(), similarity(distance) >= least).otherwise(F.size(F.array_intersect(words(claim), words(content))) >= 2)


def is_dangerous(claim: Column, table: Sequence[str] = P.DANGEROUS_CLAIMS, share: float = 0.6) -> Column:
    """Most words of a known dangerous claim occur."""
    words = F.split(F.lower(claim), r"\s+")
    return reduce(lambda a, b: a | b, [F.size(F.array_intersect(words, F.array(*map(F.lit, set_)))) >= share * len(set_) for set_ in (sorted(set(p.split())) for p in table)], F.lit(False))


def search_terms(claim: Column, table=P.SEARCH_EXPANSIONS) -> Column:
    """The claim itself, and a query for each keyword rule that fits."""
    low = F.lower(claim)
    return F.array_compact(F.array(low, *[F.when(has_any(low, keys), F.lit(term)) for keys, term in table]))


def negations(claim: Column, table=P.NEGATIONS) -> Column:
    """negated variants, by ordered substring replacement, quirks kept."""
    low = F.lower(claim)
    variants = []
    for old, new in table:
        cond = F.contains(low, F.lit(old))
        if old == "defined":
            cond = cond & ~F.contains(low, F.lit("undefined"))
        variants.append(F.when(cond, F.replace(low, F.lit(old), F.lit(new))))
    return F.array_compact(F.array(*variants, F.concat(F.lit("not "), claim), F.concat(F.lit("undefined behavior "), claim)))


def contradicts(claim: Column, content: Column, safety=P.SAFETY, danger=P.DANGER) -> Column:
    """The claim asserts what the rule warns of."""
    a, b = F.lower(claim), F.lower(content)
    safe = has_any(a, safety) & has_any(b, danger)
    never = F.contains(a, F.lit("never")) & has_any(b, ("may", "can"))
    always = F.contains(a, F.lit("always")) & F.contains(b, F.lit("not always"))
    return safe | never | always


def pattern_contradiction(claim: Column, content: Column, pairs=P.CONTRADICTION_PAIRS) -> Column:
    """The kind of the first pattern pair that fits, else null."""
    a, b = F.lower(claim), F.lower(content)
    return F.coalesce(*[F.when(F.contains(a, F.lit(x)) & F.contains(b, F.lit(y)), F.lit(kind)) for x, y, kind in pairs], _none())


def warnings(claim: Column, contents: Column, sensitive=P.SENSITIVE) -> Column:
    """What a reader should know, from the contradicting rules' contents (an array) and the claim."""
    any_has = lambda w: F.exists(contents, lambda x: F.contains(F.lower(x), F.lit(w)))
    return labels([
        ("may involve undefined behavior", any_has("undefined")), ("may depend on implementation-defined behavior", any_has("implementation")),
        ("involves security-sensitive operations", has_any(F.lower(claim), sensitive)),
    ])


# -- identifiers and specifications ----------------------------------------------------


def rule_id(module: Column, operation: Column, spec: Column, prefix: str = "c11") -> Column:
    """prefix, short module name, operation, and 8 hex digits of their md5."""
    name = F.replace(F.lower(module), F.lit("-"), F.lit("_"))
    short = F.substring(F.array_join(F.filter(F.split(name, "_"), lambda p: ~p.isin("c", "common", "syntax")), "_"), 1, 25)
    part = F.when(F.length(name) > 30, short).otherwise(name)
    return F.concat(F.lit(prefix + "_"), part, F.lit("_"), operation, F.lit("_"), F.substring(F.md5(F.concat_ws(":", module, operation, spec)), 1, 8))


def hashed_id(prefix: str, name: Column, content: Column) -> Column:
    """F2: ``prefix_name_hash`` with signs of the name as underscores."""
    return F.concat_ws("_", F.lit(prefix), F.regexp_replace(name, r"[^A-Za-z0-9]+", "_"), F.substring(F.md5(content), 1, 8))


def conditions(spec: Column) -> Column:
    """the parts of a specification between ``andBool``."""
    flat = F.regexp_replace(strip(spec), r"\s+", " ")
    return F.filter(F.transform(F.split(flat, r"\s+andBool\s+"), strip), lambda p: p != "")


def operation_of(lhs: Column) -> Column:
    """an operation's name from the signs on a rule's left side, first that fits."""
    low = F.lower(lhs)
    has = lambda *s: has_any(lhs, s)
    return (
        F.when(has("/") & ~F.contains(low, F.lit("div")), "division").when(has("%"), "modulus").when(has("*") & ~F.contains(low, F.lit("mult")), "multiplication")
        .when(has("+"), "addition").when(has("-"), "subtraction").when(has("<<", ">>"), "shift").when(has("&", "|", "^"), "bitwise")
        .when(has("==", "!=", "<", ">"), "comparison").when(has(":=", "="), "assignment").otherwise("operation")
    )


def spec_tags(spec: Column, lhs: Column) -> Column:
    """F8: tags from a specification and the operation."""
    op = operation_of(lhs)
    named = labels((tag, has_any(spec, marks)) for marks, tag in P.SPEC_TAGS)
    return F.concat(named, F.when(op != "operation", F.array(op)).otherwise(F.array().cast("array<string>")))


def function_name(block: Column, lhs: Column) -> Column:
    """the builtin's name, else the identifier before the left side's first parenthesis."""
    builtin = F.regexp_extract(block, r'builtin\s*\(\s*"([^"]+)"', 1)
    plain = F.regexp_extract(strip(lhs), r"^(?:<[^>]+>\s*)?([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", 1)
    return F.when(builtin != "", builtin).when((plain != "") & ~plain.isin(*P.NOT_FUNCTIONS), plain)


def function_calls(rhs: Column, primitives: Sequence[str] = P.PRIMITIVES) -> Column:
    """the sorted names that are called, without primitives, and all builtins."""
    called = F.regexp_extract_all(rhs, F.lit(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\("), F.lit(1))
    if primitives:
        called = F.filter(called, lambda n: ~n.isin(*primitives))
    builtin = F.regexp_extract_all(rhs, F.lit(r'builtin\s*\(\s*"([^"]+)"'), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(called, builtin)))


def cell_access(text: Column) -> Column:
    """(cell, access) of a rule, write before remove before modify before read, one each."""
    def cells(kind: str, regex: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(regex), F.lit(1)), lambda c: F.struct(c.alias("cell"), F.lit(kind).alias("access")))

    found = F.concat(
        cells("write", r"(?s)<(\w+)>[^<]*\.Map\s*=>\s*[^<]+</\1>"), cells("remove", r"(?s)<(\w+)>[^<]*?[^|]+\|->\s*_?\s*=>\s*\.Map[^<]*</\1>"),
        cells("modify", r"(?s)<(\w+)>[^<]*\([^)]+\s*=>\s*[^)]+\)[^<]*\|->[^<]*</\1>"), cells("read", r"(?s)<(\w+)>[^<]*</\1>"),
    )
    return F.filter(found, lambda x, i: ~F.exists(F.slice(found, 1, i), lambda y: y["cell"] == x["cell"]))


def spec_types(spec: Column) -> Column:
    """exceptions thrown, and pointer and null, of a formal specification."""
    thrown = F.transform(F.regexp_extract_all(spec, F.lit(r"throws\((\w+)\)"), F.lit(1)), F.lower)
    return F.array_distinct(F.concat(thrown, labels([("pointer", spec.rlike(r"(?i)\bpointer\b|\bis_pointer\b")), ("null", spec.rlike(r"(?i)\bnull\b|\bis_null\b"))])))


def exceptions(content: Column, names: Sequence[str] = P.EXCEPTIONS) -> Column:
    """the exceptions that a text names, without case."""
    low = F.lower(content)
    return labels((n, low.rlike(rf"\b{n}\b")) for n in names)


def concepts(content: Column, table: Mapping[str, str] = P.CONCEPTS) -> Column:
    """the queries of the language concepts that a text mentions, sorted.

    The table is one array literal that a lambda runs over, not a column per pattern.
    """
    low = F.lower(content)
    rules = F.array(*[F.struct(F.lit("(?i)" + k).alias("k"), F.lit(v).alias("v")) for k, v in table.items()])
    return F.array_sort(F.array_distinct(F.transform(F.filter(rules, lambda r: F.regexp(low, r["k"])), lambda r: r["v"])))


def type_references(signature: Column, content: Column, spec: Column) -> Column:
    """everything that a rule refers to: types of its signature, exceptions, concepts, types of its specification."""
    none = F.array().cast("array<string>")
    parts = (signature_types(signature, P.SIGNATURE_TYPES), exceptions(content), concepts(content), spec_types(spec))
    return F.array_sort(F.array_distinct(F.concat(*[F.coalesce(p, none) for p in parts])))


def signature_types(signature: Column, table: Mapping[str, str]) -> Column:
    """type names by a table of regular expressions, with references, pointers and std templates."""
    base = [("reference", F.contains(signature, F.lit("&"))), ("pointer", F.contains(signature, F.lit("*")))]
    found = labels([*base, *((name, signature.rlike(regex)) for regex, name in table.items())])
    template = F.regexp_extract(signature, r"std::(\w+)<", 1)
    return F.array_sort(F.array_distinct(F.concat(found, F.when(template != "", F.array(template)).otherwise(F.array().cast("array<string>")))))


def predicates(spec: Column, table: Sequence[str] = P.PREDICATES) -> Column:
    """the predicates that a specification names."""
    return labels((p, F.contains(spec, F.lit(p))) for p in table)


def terms(text: Column, table: Mapping[str, Sequence[str]] = P.ERROR_TERMS) -> Column:
    """the terms of a text, by lower-cased substrings."""
    low = F.lower(text)
    return labels((name, has_any(low, words)) for name, words in table.items())


def keywords(content: Column, table: Sequence[str] = P.KEYWORD_PATTERNS) -> Column:
    """F16: words that a rule depends on, and identifiers in capitals or with two underscores."""
    low = F.lower(content)
    named = [F.regexp_extract_all(low, F.lit(r), F.lit(1)) for r in table]
    return F.array_distinct(F.concat(*named, F.regexp_extract_all(content, F.lit(r"\b(__\w+|[A-Z][A-Z_0-9]+)\b"), F.lit(1))))


def embedding_text(content: Column, module: Column, function=None, header=None, signature=None, rule_type=None, on_violation=None, tags=None, violations=None) -> Column:
    """What is embedded of a rule; empty parts are left out."""
    part = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(label), c)) if c is not None else _none()
    return F.concat_ws(
        ". ", content, part("Function: ", function), part("Header: ", header), part("Signature: ", signature), part("Type: ", rule_type), part("On violation: ", on_violation),
        F.concat(F.lit("Module: "), F.coalesce(module, F.lit(""))), part("Tags: ", F.array_join(tags, ", ") if tags is not None else None), part("Violations: ", violations),
    )


# -- markup, sources, model text ---------------------------------------------------------

#: F17, in order: regular expression and replacement.
HTML_STEPS = (
    (r"(?is)<script[^>]*>.*?</script>", ""), (r"(?is)<style[^>]*>.*?</style>", ""),
    *((rf"(?is)<h{i}[^>]*>(.*?)</h{i}>", "\n" + "#" * i + " $1\n") for i in range(1, 5)),
    (r"(?i)<p[^>]*>|</p>", "\n"), (r"(?i)<div[^>]*>|</div>", "\n"), (r"(?i)<li[^>]*>", "\n- "), (r"(?i)</li>", ""),
    (r"(?is)<pre[^>]*>(.*?)</pre>", "\n```\n$1\n```\n"), (r"(?is)<code[^>]*>(.*?)</code>", "`$1`"), (r"(?i)<br\s*/?>", "\n"), (r"<[^>]+>", ""),
)
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"))


def html_text(source: Column) -> Column:
    """readable text of html by regular expressions."""
    out = reduce(lambda c, x: F.regexp_replace(c, *x), HTML_STEPS, source)
    out = reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), ENTITIES, out)
    out = F.regexp_replace(out, r"\n\s*\n\s*\n", "\n\n")
    return strip(F.regexp_replace(out, r"[ \t]+", " "))


def json_links(response: Column) -> Column:
    """name to list of ids from a model's answer: a fenced block, else the outermost braces, else all of it."""
    fenced = F.regexp_extract(response, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(response, r"(?s)(\{.*\})", 1)
    body = F.when(fenced != "", fenced).when(braces != "", braces).otherwise(response)
    raw = F.from_json(body, "map<string,string>")
    lists = F.map_filter(raw, lambda k, v: F.startswith(v, F.lit("[")))
    return F.coalesce(F.transform_values(lists, lambda k, v: F.from_json(v, "array<string>")), F.create_map().cast("map<string,array<string>>"))


def json_records(response: Column, schema: str = "content string, formal_spec string") -> Column:
    """the records of a JSON list inside a model's answer, without those that lack content."""
    rows = F.from_json(F.regexp_extract(response, r"(\[[\s\S]*\])", 1), f"array<struct<{', '.join(f'{n}:{t}' for n, t in (x.split() for x in schema.split(',')))}>>")
    return F.coalesce(F.filter(rows, lambda r: r["content"].isNotNull()), F.array().cast(f"array<struct<{', '.join(f'{n}:{t}' for n, t in (x.split() for x in schema.split(',')))}>>"))


def line_slice(source: Column, first: Column, last: Column) -> Column:
    """lines ``first`` to ``last``, from 1."""
    return F.array_join(F.slice(F.split(source, "\n"), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def macro_features(body: Column) -> Column:
    """what a macro's body does."""
    calls = F.filter(F.regexp_extract_all(body, F.lit(r"\b([a-z_][a-zA-Z_0-9]*)\s*\("), F.lit(1)), lambda n: ~n.isin(*P.MACRO_KEYWORDS))
    return F.struct(
        body.rlike(r"[^/]/[^/*]|%").alias("has_division"), body.rlike(r"\*[a-zA-Z_]|&[a-zA-Z_]").alias("has_pointer_ops"),
        body.rlike(r"\([a-zA-Z_][a-zA-Z_0-9]*\s*\*?\s*\)").alias("has_casts"), calls.alias("function_calls"),
        F.regexp_extract_all(body, F.lit(r"\b([A-Z_][A-Z_0-9]{2,})\b"), F.lit(1)).alias("referenced_macros"),
    )


def macro_hazard(features: Column) -> Column:
    """P10: whether a macro needs rules."""
    return features["has_division"] | features["has_pointer_ops"] | features["has_casts"] | (F.size(features["function_calls"]) > 0)


def macro_signature(name: Column, params: Column, function_like: Column) -> Column:
    """F25."""
    return F.when(function_like, F.concat(name, F.lit("("), F.array_join(params, ", "), F.lit(")"))).otherwise(name)


def retrieval_queries(has_division: Column, has_pointer: Column, has_array: Column, has_memory: Column, calls: Column) -> Column:
    """what to search for, from the profile of a function's operations."""
    empty = F.array().cast("array<string>")
    some = lambda cond, *q: F.when(cond, F.array(*map(F.lit, q))).otherwise(empty)
    return F.concat(
        some(has_division, "division by zero undefined behavior integer modulo"), some(has_pointer, "null pointer dereference undefined behavior", "pointer validity lifetime"),
        some(has_array, "array index bounds out of range undefined behavior"), some(has_memory, "malloc free memory allocation deallocation", "new delete memory leak double free"),
        F.transform(F.array_distinct(calls), lambda c: F.concat(c, F.lit(" precondition semantics"))),
    )


def glob_regex(glob: str) -> str:
    """A shell pattern as a regular expression; ``*`` crosses slashes, as in fnmatch."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return f"(?s)^{out}$"


def ignored(path: Column, globs: Sequence[str]) -> Column:
    """Whether a relative path is excluded by patterns as in an ignore file."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    prefixes = F.transform(dirs, lambda d, i: F.array_join(F.slice(parts, 1, i + 1), "/"))
    any_fits = lambda items, regex: F.exists(items, lambda p: p.rlike(regex))
    tests = []
    for g in globs:
        if g.endswith("/"):
            tests.append(any_fits(F.concat(dirs, prefixes), glob_regex(g.rstrip("/"))))
        elif "/" in g:
            tests.append(path.rlike(glob_regex(g)))
        else:
            tests.append(any_fits(parts, glob_regex(g)))
    return reduce(lambda a, b: a | b, tests, F.lit(False))
