"""Text expressions: tokens, markdown, links, names, hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Possessive, so that a chain of any length is matched without recursion.
TOKEN = r"[\p{L}\p{Nd}]++(?:-[\p{L}\p{Nd}]++)*+"
# Words that the tokenizer leaves out.
STOP_WORDS = (
    "a an and are as at be been being but by can could do does did for from had has have he her here him his how i if in into is it its just "
    "me my no not now of on or our s she should so some than that the their them then there these they this those through to too up use "
    "was we were what when where which while who will with would you your"
).split()
# Verb, type of the relation and its confidence.
VERBS = {
    "depends on": ("depends-on", 0.80), "requires": ("depends-on", 0.80), "calls": ("calls", 0.75), "uses": ("mentions", 0.70),
    "integrates with": ("depends-on", 0.65), "connects to": ("depends-on", 0.65), "provides": ("implements", 0.70), "communicates with": ("depends-on", 0.65),
}
# Forms of the verbs in a sentence.
VERB_FORMS = (
    (r"(?:depends?|depended)\s+on", "depends on"),
    (r"requires?", "requires"),
    (r"(?:calls?|invokes?)", "calls"),
    (r"uses?", "uses"),
    (r"integrates?\s+with", "integrates with"),
    (r"connects?\s+to", "connects to"),
    (r"(?:provides?|exposes?|exports?)", "provides"),
    (r"(?:communicates?\s+with|talks?\s+to)", "communicates with"),
    (r"sends?\s+(?:a\s+)?(?:request|data|message|event)s?\s+to", "calls"),
    (r"(?:validates?|authenticates?|verifies?)\s+(?:via|through|using)", "depends on"),
    (r"is\s+(?:submitted|sent|forwarded|passed)\s+to", "calls"),
)
#: Every verb form holds one of these.
VERB_STEMS = ("depend", "require", "call", "invoke", "use", "integrate", "connect", "provide", "expose", "export", "communicate", "talk", "send", "validate", "authenticate", "verif", "submitted", "sent", "forwarded", "passed")
# Words of headings whose sections list relations.
DEPENDENCY_SECTIONS = ("dependencies", "depends on", "requires", "prerequisites", "calls", "integrates", "integration points", "integration", "related services", "related")
# Scheme of an address, type of what it leads to.
SCHEMES = {
    "postgres": "database", "postgresql": "database", "mysql": "database", "mongodb": "database", "mongodb+srv": "database", "redis": "cache", "rediss": "cache",
    "amqp": "message-broker", "amqps": "message-broker", "nats": "message-broker", "http": "service", "https": "service",
}
# Hosts of documentation, examples and the machine itself, which are no dependency.
FILTERED_HOSTS = (
    "example.com", "example.org", "example.net", "localhost", "127.0.0.1", "0.0.0.0", "docs.python.org", "pkg.go.dev", "developer.mozilla.org", "github.com", "stackoverflow.com",
    "en.wikipedia.org", "www.w3.org", "tools.ietf.org", "registry.npmjs.org", "pypi.org", "rubygems.org", "hub.docker.com", "schemas.xmlsoap.org", "www.googleapis.com", "json-schema.org", "purl.org",
)


def tokens(text: Column, stop: tuple[str, ...] | list[str] = STOP_WORDS) -> Column:
    """Lower-case words of two characters or more, hyphens kept inside, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*stop))


def plain_line(line: Column) -> Column:
    """A markdown line without its markers, emphasis, code ticks and link targets."""
    out = F.regexp_replace(line, r"^\s*(?:#{1,6}\s+|[-*+]\s+|\d+\.\s+|>\s?)", "")
    out = F.regexp_replace(out, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(out, r"[*_`]", "")


def strip_markdown(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~F.startswith(F.ltrim(x), F.lit("```")))
    return F.array_join(F.transform(lines, plain_line), "\n")


def title(text: Column, path: Column) -> Column:
    """The first top-level heading, else the file's stem."""
    heading = F.trim(F.regexp_extract(text, r"(?m)^[^\S\n]*+#[ \t]+(.+)$", 1))
    return F.when(F.coalesce(heading, F.lit("")) != "", heading).otherwise(stem(path))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/", 1)


def kebab(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"[\s_]+", "-")


def aliases(name: Column) -> Column:
    """The name, its kebab form, and both without a service-like suffix."""
    short = F.regexp_replace(kebab(name), r"-(?:service|api|server|svc|db|component)$", "")
    return F.array_distinct(F.array(name, kebab(name), short))


def name_tokens(name: Column) -> Column:
    parts = F.split(F.lower(name), r"[._/\s-]+")
    return F.array_distinct(F.filter(parts, lambda p: (F.length(p) >= 2) & ~p.isin("svc", "app", "the")))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the size of the smaller set; 0 if either is empty."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(F.lit(0.0))


def suggestion_score(query: Column, name: Column) -> Column:
    """Substring either way 2, common three-character prefix 1, one for every shared word."""
    q, n = F.lower(query), F.lower(name)
    inside = F.when(F.contains(n, q) | F.contains(q, n), 2).otherwise(0)
    prefix = F.when((F.length(q) >= 3) & (F.substring(q, 1, 3) == F.substring(n, 1, 3)), 1).otherwise(0)
    return inside + prefix + F.size(F.array_intersect(name_tokens(q), name_tokens(n)))


def links(text: Column) -> Column:
    """Targets of markdown links that are no web address, without fragment and query."""
    found = F.regexp_extract_all(text, F.lit(r"\[[^\[\]]*+\]\(([^)\s]++)\)"), F.lit(1))
    kept = F.filter(found, lambda t: ~F.regexp(t, F.lit(r"^(?:[a-z][a-z0-9+.-]*:|#|//)")))
    return F.transform(kept, lambda t: F.regexp_replace(t, r"[#?].*$", ""))


def resolved_path(path: Column) -> Column:
    """A path without ``.``, empty and ``..`` parts; a ``..`` above the root is left out."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    none = F.array().cast("array<string>")
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    walked = F.array_join(F.aggregate(parts, none, lambda done, p: F.when(p == "..", up(done)).otherwise(F.array_append(done, p))), "/")
    return F.when(F.regexp(path, F.lit(r"(?:^|/)\.{0,2}(?:/|$)")), walked).otherwise(path)


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""href=["']([^"']+)["']"""), F.lit(1))


def endpoints(line: Column) -> Column:
    """Distinct ``METHOD /path`` pairs."""
    found = F.regexp_extract_all(line, F.lit(r"(?i)\b((?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+/[A-Za-z0-9_/{}.:-]*)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda e: F.concat(F.upper(F.substring_index(e, " ", 1)), F.lit(" "), F.substring_index(e, " ", -1))))


def connection_host(value: Column) -> Column:
    """Host of a URL, a MySQL tcp() address, a host= pair or host:port; empty if none."""
    url = F.regexp_extract(value, r"^[a-z][a-z0-9+.-]*://(?:[^@/\s]*@)?([A-Za-z0-9._-]+)", 1)
    tcp = F.regexp_extract(value, r"tcp\(([A-Za-z0-9._-]+)", 1)
    pair = F.regexp_extract(value, r"(?:^|\s)host=([A-Za-z0-9._-]+)", 1)
    port = F.regexp_extract(value, r"^([A-Za-z0-9._-]+):\d+$", 1)
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (url, tcp, pair, port)], F.lit(""))


def connection_target(value: Column) -> Column:
    """The host, empty for one that is no dependency (documentation, examples, the machine itself)."""
    # a function over an array of one stands for a variable: the host is looked up once
    return F.get(F.transform(F.array(connection_host(value)), lambda host: F.when(host.isin(*FILTERED_HOSTS), F.lit("")).otherwise(host)), F.lit(0))


def connection_type(value: Column) -> Column:
    """What the address leads to: by its scheme; a tcp() address or a host= pair is a database."""
    scheme = F.lower(F.regexp_extract(value, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    known = F.create_map(*[F.lit(x) for item in SCHEMES.items() for x in item])[scheme]
    dsn = (scheme == "") & F.regexp(value, F.lit(r"@tcp\([^:)]+(?::\d+)?\)|\bhost=\S+"))
    return F.coalesce(known, F.when(dsn, F.lit("database")), F.lit("unknown"))


def env_names(text: Column) -> Column:
    """Environment variables read in Go, Python, JavaScript and shell."""
    name = "([A-Z_][A-Z0-9_]*)"
    patterns = (
        rf"""os\.(?:Getenv|LookupEnv|getenv)\(["']{name}""", rf"""os\.environ(?:\.get\(|\[)["']{name}""", rf"process\.env\.{name}",
        rf"""process\.env\[["']{name}["']\]""", rf"\$\{{{name}[}}:]", rf"\${name}\b",
    )
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])))


def snippet(text: Column, term: Column, around: int = 30) -> Column:
    """White space collapsed, ``around`` characters before the first match and as many after it."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    at = F.instr(F.lower(flat), F.lower(term))
    begin = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substr(flat, begin, F.lit(2 * around) + F.length(term))).otherwise(F.substring(flat, 1, 2 * around))


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, pos, line`` with positions from 0; null text has no lines."""
    return docs.select("doc_id", F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
