"""Secret scan with linking of multipart credentials, with DataFrame functions alone.

Strong kinds are reported by themselves. Weak kinds - an access identifier, a value that may be a
secret, an endpoint - are only reported where complementary parts stand within one scope (at most
``REACH`` characters apart): an identifier with a secret, or a secret with an endpoint. That is an
interval join; as all parts of a document are in its row, it runs as a merge over the sorted spans,
once from the left and once from the right, and the plan has no shuffle that a hot key could skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_row, free_name, from_row
from .spans import BLOCK, let, matches, scan

REACH = 300
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, rank in the output, role, pattern, group and its least length, words of which one must occur in the lower-cased text
STRONG = (
    ("assign", 0, "secret", ASSIGN, 2, 8, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    ("access", 1, "identifier", r"AKIA[A-Z0-9]+", 0, 16, ("akia",)),
    ("hex", 2, "secret", r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32, ()),
)
WEAK = (
    ("client", 3, "identifier", r"(?i)(?:client_?id|access_?key_?id|user(?:name)?|login|account)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]+)", 1, 3, ("client", "access", "user", "login", "account")),
    ("endpoint", 4, "endpoint", r"(?i)(?:https?|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp)://[^\s\"'<>]+|(?:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._:/-]+", 0, 8, ("://", "host", "endpoint", "server")),
    ("value", 5, "secret", r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/=_-])", 0, 20, None),
)
SPAN = "array<struct<start:int,rank:int,stop:int,kind:string,role:string>>"
#: Which roles complete which.
PARTNER = {"identifier": ("secret",), "endpoint": ("secret",), "secret": ("identifier", "endpoint")}


def _spans(text: str, kind: str, rank: int, role: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost matches that do not overlap, if the group is long enough."""
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr(f"transform(filter({matches(text, p, group)}, m -> m.len >= {least}), m -> named_struct('start', m.start, 'rank', {rank}, 'stop', m.stop, 'kind', '{kind}', 'role', '{role}'))")


def _linked(spans: str, forward: bool) -> str:
    """For each span, whether a complementary part that comes before it (after it) is within reach."""
    here, far = ("x.start - {}", "-1000000000") if forward else ("{} - x.stop", "1000000000")
    edge, pick = ("x.stop", "greatest") if forward else ("x.start", "least")
    near = lambda role: f"{here.format('s.s.' + role)} <= {REACH}"
    test = "CASE x.role " + " ".join(f"WHEN '{r}' THEN {' OR '.join(near(o) for o in others)}" for r, others in PARTNER.items()) + " END"
    source = spans if forward else f"reverse({spans})"
    state = "named_struct(" + ", ".join(f"'{r}', {{}}" for r in PARTNER) + ")"
    after = state.format(*(f"IF(x.role = '{r}', {pick}(s.s.{r}, {edge}), s.s.{r})" for r in PARTNER))
    near = scan(source, state.format(*[far] * len(PARTNER)), after, test, "boolean")
    return near if forward else f"reverse({near})"


def scan_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with a struct column ``out`` (a column of that name is replaced; other columns stay).

    Fields: ``base``, the spans of the strong kinds, and ``spans``, these and the linked weak ones,
    both as arrays of (start, rank, stop, kind, role) in code points, by start, then kind. A null or
    empty text has none; repeated rows are scanned each for itself; a weak span that overlaps a
    strong one is part of it and is not reported again.
    """
    df = docs.select(as_row(docs), F.coalesce(F.col(text), F.lit("")).alias("__t")).withColumn("__l", F.lower("__t"))
    none = F.expr(f"CAST(array() AS {SPAN})")

    def column(name, kinds, gate):
        parts = []
        for kind, rank, role, pattern, group, least, words in kinds:
            worth = F.rlike("__t", F.lit(pattern))
            if words:
                any_word = F.contains("__l", F.lit(words[0]))
                for w in words[1:]:
                    any_word = any_word | F.contains("__l", F.lit(w))
                worth = any_word & worth
            parts.append(F.when(gate & worth, _spans("__t", kind, rank, role, pattern, group, least)).otherwise(none))
        return F.array_sort(F.concat(*parts)).alias(name)

    df = df.withColumn("__base", column("__base", STRONG, F.lit(True)))
    # Weak parts need a partner, so there must be a word that a secret or an endpoint needs.
    hint = F.size("__base") > 0
    for w in sorted({w for *_, words in WEAK for w in words or ()}):
        hint = hint | F.contains("__l", F.lit(w))
    df = df.withColumn("__weak", column("__weak", WEAK, hint)).drop("__l")
    # Weak spans that overlap a strong one before or behind them are part of it.
    df = df.withColumn("__both", F.expr("array_sort(concat(__base, __weak))"))
    before = scan("__both", "-1", "IF(x.rank < 3, greatest(s.s, x.stop), s.s)", "x.rank >= 3 AND s.s > x.start", "boolean")
    behind = scan("reverse(__both)", "2147483647", "IF(x.rank < 3, least(s.s, x.start), s.s)", "x.rank >= 3 AND s.s < x.stop", "boolean")
    within = f"zip_with({before}, reverse({behind}), (a, b) -> a OR b)"
    apart = f"transform(filter(zip_with(__both, {within}, (x, i) -> named_struct('x', x, 'i', i)), z -> NOT z.i), z -> z.x)"
    df = df.withColumn("__all", F.expr(f"IF(size(__weak) = 0, __base, {apart})"))
    near = F.expr(f"IF(size(__weak) = 0, CAST(NULL AS array<boolean>), zip_with({_linked('__all', True)}, {_linked('__all', False)}, (a, b) -> coalesce(a, false) OR coalesce(b, false)))")
    df = df.withColumn("__near", near)
    kept = F.expr("IF(__near IS NULL, __all, transform(filter(zip_with(__all, __near, (x, y) -> named_struct('x', x, 'y', y)), z -> z.y OR z.x.rank < 3), z -> z.x))")
    return df.select(*from_row(docs.columns, **{out: F.struct(F.col("__base").alias("base"), kept.alias("spans"))}))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def op2_secret_scan(docs: DataFrame) -> DataFrame:
    """Counts and spans of each row of ``docs``; a null or empty text has none, repeated rows are scanned each for itself, other columns are not read, no rows give no rows."""
    x = scan_secrets(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return x.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed(F.col("secrets.base")), 256).alias("base_sha256"), _listed(F.col("secrets.spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by its kind in brackets; other rows and columns stay."""
    name = free_name(docs, "secrets")
    x = scan_secrets(docs, text, name)
    x = x.select(as_row(x), F.col(text).alias("__text"), F.col(f"{name}.spans").alias("__spans"))
    # Overlapping spans are cut once: the text goes on at the furthest end so far. Pieces are taken out of
    # the part of the text that a block of them covers, as finding a place in a text takes its length.
    pieces = scan("__spans", "0", "greatest(s.s, x.stop)", "IF(x.start < s.s, NULL, named_struct('a', s.s, 'b', x.start, 'kind', x.kind))", "struct<a:int,b:int,kind:string>")
    some = f"transform(sequence(0, (size(cuts) - 1) DIV {BLOCK}), b -> slice(cuts, b * {BLOCK} + 1, {BLOCK}))"
    put = "concat(substring(part, p.a - k[0].a + 1, p.b - p.a), '[', p.kind, ']')"
    block = let(f"substring(__text, k[0].a + 1, element_at(k, -1).b - k[0].a)", "part", f"array_join(transform(k, p -> {put}), '')")
    cut = F.expr(let(f"filter({pieces}, p -> p IS NOT NULL)", "cuts", f"concat(array_join(transform({some}, k -> {block}), ''), substring(__text, array_max(transform(__spans, x -> x.stop)) + 1))"))
    return x.select(*from_row(docs.columns, **{text: F.when(F.size("__spans") > 0, cut).otherwise(F.col("__text"))}))
