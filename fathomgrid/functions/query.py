"""Analysis of search queries: identifiers, paths, expansion, intent, kind and routing, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomgrid.functions.text import camel_parts, kebab_parts, snake_parts

#: Words with which a query's word is expanded.
SYNONYMS = {
    "retry": "backoff exponential timeout reattempt resilience", "backoff": "retry exponential delay jitter throttle", "timeout": "deadline cancel abort timeoutms duration",
    "auth": "authentication login session token credential oauth jwt", "authentication": "auth login signin credential identity", "permission": "authorization access role privilege acl rbac",
    "authorization": "permission access role privilege policy", "validation": "validate sanitize check verify schema input", "sanitize": "validation escape clean filter xss injection",
    "cache": "caching memoize ttl expiry invalidate lru redis", "ttl": "cache expiry expire timeout eviction", "database": "db sql query transaction pool connection postgres mysql",
    "transaction": "atomic commit rollback database acid", "error": "exception error failure throw catch handle", "exception": "error throw catch try failure", "logging": "log logger debug trace audit monitor",
    "config": "configuration settings env environment options", "http": "request response api rest fetch client server", "request": "http api fetch call client", "response": "http result return data body",
    "queue": "message broker async worker job kafka rabbitmq", "encrypt": "crypto cipher decrypt security hash aes rsa", "decrypt": "encrypt crypto cipher security", "security": "crypto encrypt auth token secure ssl tls",
    "date": "time datetime timestamp format parse utc timezone", "time": "date datetime timestamp duration interval", "user": "account profile identity customer member", "file": "filesystem path read write disk storage",
    "test": "spec mock fixture assert expect jest mocha",
}
#: Shapes of identifiers, in the order in which they are looked for.
IDENTIFIERS = (r"\b[a-z][a-z0-9]*(?:[A-Z][a-z0-9]*)+\b", r"\b[A-Z][a-z0-9]*(?:[A-Z][a-z0-9]*)+\b", r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b", r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b", r"\b[A-Z][A-Z0-9]{2,}\b")
#: Words and phrases that tell what a query is after.
INTENTS = {
    "usage": ("who uses", "where used", "callers of", "who calls", "references to", "where is", "find usages"),
    "navigation": ("go to", "open", "show me", "find file", "navigate to", "jump to"),
    "semantic": ("how do i", "how to", "what does", "explain", "example of", "implement", "create"),
}
DEFINITION = ("define", "definition", "declaration", "declare", "interface", "class", "type", "function")
#: Weights of full text, vectors and graph by intent.
BOOSTS = {"exact_symbol": (1.5, 0.8, 0.7), "definition": (1.3, 0.9, 0.8), "usage": (1.0, 0.7, 1.5), "navigation": (1.3, 0.8, 0.9), "semantic": (0.8, 1.5, 0.7), "hybrid": (1.0, 1.0, 1.0)}
#: Words of faults, and how each kind of query is reranked.
FAULTS = ("error", "exception", "crash", "fail", "failed", "failure", "timeout", "timed out", "bug", "broken", "panic")
RERANK = {"exact_identifier": "heuristic", "semantic": "model", "bug_error": "heuristic", "unknown": "heuristic"}


def identifiers(query: Column) -> Column:
    found = [F.regexp_extract_all(query, F.lit(p), F.lit(0)) for p in IDENTIFIERS]
    return F.array_distinct(F.concat(*found))


def paths(query: Column) -> Column:
    unix = F.regexp_extract_all(query, F.lit(r"(?:^|\s)([a-zA-Z0-9_\-./]+/[a-zA-Z0-9_\-./]+)(?=\s|$)"), F.lit(1))
    module = F.regexp_extract_all(query, F.lit(r"@?[a-zA-Z0-9_\-]+/[a-zA-Z0-9_\-./]+"), F.lit(0))
    return F.array_distinct(F.concat(unix, F.filter(module, lambda p: ~p.startswith("@"))))


def expanded_terms(query: Column) -> Column:
    """Each word with its synonyms and its parts, in lower case, longer than one character, in order and without repeats."""
    synonyms = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    of = lambda w: F.concat(F.array(w), F.filter(F.split(F.coalesce(F.try_element_at(synonyms, F.lower(w)), F.lit("")), " "), lambda s: s != ""), camel_parts(w), snake_parts(w), kebab_parts(w))
    every = F.transform(F.flatten(F.transform(F.split(F.trim(query), r"\s+"), of)), F.lower)
    return F.array_distinct(F.filter(every, lambda t: F.length(t) > 1))


def intent(query: Column) -> Column:
    low, ids = F.lower(F.trim(query)), identifiers(query)
    words = F.split(low, r"\s+")
    some = lambda kind: F.array_contains(F.array(*[low.contains(p) for p in INTENTS[kind]]), True)
    return (
        F.when((F.size(ids) == 1) & (F.size(words) == 1) & (F.size(paths(query)) == 0), "exact_symbol").when(F.arrays_overlap(words, F.array(*map(F.lit, DEFINITION))), "definition")
        .when(some("usage"), "usage").when(some("navigation"), "navigation").when(some("semantic"), "semantic").when(F.size(paths(query)) > 0, "navigation").otherwise("hybrid")
    )


def kind(query: Column) -> Column:
    """(kind, confidence): exact_identifier, bug_error, semantic or unknown."""
    q = F.trim(query)
    one = ~q.rlike(r"\s")
    strong = q.rlike(r"^[a-z][a-z0-9]*[A-Z][a-zA-Z0-9]*$|^[A-Z][a-z]+[A-Z][a-zA-Z0-9]*$|^[a-z][a-z0-9]*(_[a-z0-9]+)+$|^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$|^[A-Z][A-Z0-9_]{2,}$")
    plain = q.rlike(r"^[a-z]+$|^[A-Z][a-z]{1,3}$")
    medium = q.rlike(r"\b[a-z][a-z0-9]*[A-Z][a-zA-Z0-9]*\b|\b[A-Z][a-z]+[A-Z][a-zA-Z0-9]*\b|[a-zA-Z0-9_-]+\.[a-zA-Z]{1,4}$|[a-zA-Z0-9_-]+/[a-zA-Z0-9_-]+|\w+\([^)]*\)|\b[a-z][a-z0-9]*(_[a-z0-9]+)+\b")
    low = F.lower(q)
    fault = low.rlike("^(" + "|".join(FAULTS) + ")( |$)|(^| )(" + "|".join(FAULTS) + ")$")
    faulty = q.rlike(r"(?i)\b(error|exception|crash|fail(ure|ed)?|timeout|bug|broken|panic)\b|not work(ing)?|doesn'?t work|something wrong|unexpected behavior")
    count = F.size(F.split(q, r"\s+"))
    asked = q.rlike(r"(?i)\b(how|what|why|when|where|which|who|find|search|look|show|get|list|display|explain|describe|the|a|an|for|with|from|into|about)\b|\b(looking for|trying to|want to|need to|help me)\b")
    is_ = lambda k, c: F.struct(F.lit(k).alias("kind"), F.lit(c).alias("confidence"))
    return (
        F.when(q == "", is_("unknown", "low")).when(one & strong, is_("exact_identifier", "high")).when(~(one & plain) & medium, is_("exact_identifier", "medium"))
        .when(fault, is_("bug_error", "high")).when(faulty, is_("bug_error", "medium")).when(count >= 5, is_("semantic", "high")).when(asked, is_("semantic", "medium"))
        .when((count >= 2) & ~q.rlike("[A-Z][a-z]+[A-Z]"), is_("semantic", "low")).otherwise(is_("unknown", "low"))
    )


def rerank_method(kind_: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in RERANK.items() for x in kv]), kind_)


def path_prior(path: Column, query: Column) -> Column:
    """Factor of a path: less for tests unless the query is about them, more for files that arrange others."""
    from fathomgrid.functions.text import is_test_path

    low, words = F.lower(query), F.split(F.lower(query), r"\s+")
    about = F.arrays_overlap(words, F.array(*map(F.lit, ("test", "tests", "spec", "integration", "unit", "e2e", "regression")))) | low.rlike(r"\btest(ing)?\b|\bspec(s)?\b")
    factor = F.when(is_test_path(path) & ~about, 0.82).otherwise(1.0)
    for word in ("factory", "manager", "registry", "builder"):
        factor = factor * F.when(F.lower(path).contains(word), F.when(F.array_contains(words, word), 1.25).otherwise(1.15)).otherwise(1.0)
    return F.least(F.greatest(factor, F.lit(0.65)), F.lit(1.35))
