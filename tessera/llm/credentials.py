"""Secrets in texts, and credentials whose parts stand apart: identifiers, secrets and endpoints near each other.

Strong patterns are reported wherever they match. Weak ones (a user name, a short password, an address) say little alone; they
are reported only where the parts that complete them lie in the same scope, which an interval join over binned positions
finds. All of it is built-in functions: matches come from extracting a pattern, their places from the lengths of what a split
by the same pattern leaves between them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import Scratch, bound

#: Parts belong together if at most so many code points lie between them.
SCOPE = 200
#: Lengths are summed in runs of this many, so that a text with many matches isn't copied for each.
RUN = 256


def any_case(word: str) -> str:
    """The word with each letter in either case (of A-Z alone, in any engine)."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _words(*words: str) -> str:
    return "|".join(any_case(w) for w in words)


#: Between a name and its value.
IS = r"[\"']?\x20*[:=]\x20*[\"']?"


@dataclass(frozen=True)
class Kind:
    """A pattern, the role of its matches, and how long group ``measured`` of a match must be."""

    name: str
    role: str
    pattern: str
    least: int = 0
    measured: int = 0
    strong: bool = False


#: In the order in which kinds at one place are listed. A repetition with a least length finds the same as one without whose
#: short matches are dropped, where a match ends with its run and starts at the run's first place.
KINDS = (
    Kind("assign", "secret", rf"({_words('password', 'passwd', 'secret', 'token')}|{any_case('api')}_?{any_case('key')}){IS}([A-Za-z0-9+/_.=-]+)", 12, 2, True),
    Kind("access", "id", r"AKIA[A-Z0-9]{14,}", strong=True),
    Kind("hex", "", r"[0-9a-f]{16,}", strong=True),
    Kind("identifier", "id", rf"({_words('username', 'user', 'login', 'account')}|{any_case('client')}_?{any_case('id')}|{any_case('access')}_?{any_case('key')}(_?{any_case('id')})?){IS}([A-Za-z0-9@._+-]+)", 3, 3),
    Kind("short", "secret", rf"({_words('password', 'passwd', 'passphrase', 'pwd', 'secret', 'token')}|{any_case('api')}_?{any_case('key')}){IS}([!-~]+)", 4, 2),
    Kind("endpoint", "endpoint", rf"([a-z][a-z0-9+]{{1,15}}://[A-Za-z0-9._@:-]+|({_words('host', 'endpoint', 'server')}){IS}[A-Za-z0-9._:-]+)", 8),
)
ORDER = [k.name for k in KINDS]
STRONG = [k.name for k in KINDS if k.strong]
#: Which roles must be near for a weak match of a role to be reported: one set of them at least.
COMPLETE = {"id": [{"secret"}], "secret": [{"id"}, {"endpoint"}], "endpoint": [{"id", "secret"}]}
Part = "struct<first:bigint,last:bigint,rank:int>"


def _sums(x: Column) -> Column:
    nothing = F.array().cast("array<bigint>")
    return F.aggregate(x, nothing, lambda done, v: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0).cast("bigint")) + v)))


def running(x: Column) -> Column:
    """Sums of the first 1, 2, ... numbers of an array of longs that isn't empty: by runs, then over the runs."""
    runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / RUN).cast("int") - 1), lambda j: _sums(F.slice(x, j * RUN + 1, F.lit(RUN))))
    return bound(runs, lambda own: bound(_sums(F.transform(own, lambda r: F.element_at(r, -1))), lambda all_: F.flatten(F.transform(own, lambda r, j: F.transform(r, lambda v: v + F.when(j > 0, F.get(all_, j - 1)).otherwise(F.lit(0).cast("bigint")))))))


def matches(text: Column, kind: Kind) -> Column:
    """(first, last, rank) of each match that is long enough, in code points, last exclusive; empty without a match."""
    pattern = F.lit(kind.pattern)
    long = lambda c: F.char_length(c).cast("bigint")
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    size = F.transform(found, long)
    gaps = F.transform(F.split(text, kind.pattern, -1), long)
    value = size if not kind.measured else F.transform(F.regexp_extract_all(text, pattern, F.lit(kind.measured)), long)

    def spans(n: Column, m: Column) -> Column:
        ends = running(F.zip_with(F.slice(gaps, F.lit(1), F.size(n)), n, lambda a, b: a + b))
        each = F.zip_with(ends, n, lambda e, k: F.struct((e - k).alias("first"), e.alias("last"), F.lit(ORDER.index(kind.name)).alias("rank")))
        return F.transform(F.filter(F.arrays_zip(each.alias("s"), m.alias("m")), lambda z: z["m"] >= kind.least), lambda z: z["s"])

    inside = bound(size, lambda n: bound(value, lambda m: spans(n, m)))
    return F.when(text.rlike(kind.pattern), inside).otherwise(F.array().cast(f"array<{Part}>"))


def _role(rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(k.role) for k in KINDS)), rank + 1)


def complete(parts: DataFrame) -> DataFrame:
    """row, first, last, rank of the weak parts that others complete; parts has these columns of all parts.

    An interval join: a weak part is filed under each bin of its own places, others under each bin within SCOPE of theirs. A
    bin has room for few parts, so a text with very many has pairs in proportion. A weak part inside or across a strong match is
    none.
    """
    bins = lambda first, last: F.sequence(F.floor(first / SCOPE), F.floor((last - 1) / SCOPE))
    role = _role(F.col("rank"))
    weak = parts.filter(F.col("rank") >= len(STRONG)).withColumn("bin", F.explode(bins(F.col("first"), F.col("last"))))
    near = parts.select("row", F.col("first").alias("a"), F.col("last").alias("b"), role.alias("role"), (F.col("rank") < len(STRONG)).alias("strong"))
    near = near.withColumn("bin", F.explode(bins(F.greatest(F.col("a") - SCOPE, F.lit(0)), F.col("b") + SCOPE + 1)))
    pairs = weak.join(near, ["row", "bin"]).filter((F.col("a") <= F.col("last") + SCOPE) & (F.col("b") + SCOPE >= F.col("first")))
    overlaps = F.col("strong") & (F.col("a") < F.col("last")) & (F.col("b") > F.col("first"))
    seen = pairs.groupBy("row", "first", "last", "rank").agg(F.bool_or(overlaps).alias("_taken"), *(F.bool_or(F.col("role") == r).alias(f"_{r}") for r in COMPLETE))
    done = F.lit(False)
    for own, sets in COMPLETE.items():
        for needed in sets:
            all_ = F.lit(True)
            for r in needed:
                all_ = all_ & F.col(f"_{r}")
            done = done | ((role == own) & all_)
    return seen.filter(~F.col("_taken") & done).select("row", "first", "last", "rank")


def listed(parts: Column) -> Column:
    """``kind:first:last`` of each part, comma-joined; parts are sorted."""
    name = lambda p: F.element_at(F.array(*map(F.lit, ORDER)), p["rank"] + 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(name(p), F.lit(":"), p["first"].cast("string"), F.lit(":"), p["last"].cast("string"))), ",")


def by_place(parts: Column) -> Column:
    """Sorted by first place, then kind, then last place."""
    sorted_ = F.array_sort(F.transform(parts, lambda p: F.struct(p["first"].alias("first"), p["rank"].alias("rank"), p["last"].alias("last"))))
    return F.transform(sorted_, lambda p: F.struct(p["first"].alias("first"), p["last"].alias("last"), p["rank"].alias("rank")))


def scan(docs: DataFrame, *carried: str) -> DataFrame:
    """The carried columns, strong and all: sorted arrays of (first, last, rank) for each row of docs (its column text).

    Null text is empty. ``strong`` holds the matches of strong kinds, ``all`` also the weak ones that others complete.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(carried))).alias("kept"), text.alias("text"))
    found = found.select("kept", *(matches(F.col("text"), k).alias(k.name) for k in KINDS))
    parts = F.concat(*(F.col(k.name) for k in KINDS))
    facts = scratch.keep(found.select(F.monotonically_increasing_id().alias("row"), "kept", by_place(F.concat(*(F.col(k) for k in STRONG))).alias("strong"), parts.alias("parts")))
    apart = facts.filter(F.exists("parts", lambda p: p["rank"] >= len(STRONG))).select("row", F.inline("parts"))
    weak = complete(apart).groupBy("row").agg(F.collect_list(F.struct("first", "last", "rank")).alias("more"))
    joined = facts.join(weak, "row", "left")
    both = by_place(F.concat("strong", F.coalesce("more", F.array().cast(f"array<{Part}>"))))
    return joined.select(*(F.col(f"kept.c{i}").alias(c) for i, c in enumerate(carried)), "strong", both.alias("all"))


def op11_credentials(docs: DataFrame) -> DataFrame:
    """doc_id, counts of each strong kind, the digest of their list, and the list with the completed weak ones.

    Null and empty texts have no spans. Repeated rows, also with one doc_id or none, are scanned one by one. Texts of any length
    are scanned whole; the list of one text's spans is one value. Kinds of different patterns may overlap, and each is listed.
    An empty table gives no rows; other columns take no part.
    """
    found = scan(docs, "doc_id")
    count = lambda k: F.size(F.filter("strong", lambda p: p["rank"] == ORDER.index(k))).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in STRONG), F.sha2(listed(F.col("strong")), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    out = ["docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents)"]
    for i, k in enumerate(KINDS):
        got = f"SELECT r, unnest(regexp_extract_all(t, {q(k.pattern)}, 0)) AS m, unnest(regexp_extract_all(t, {q(k.pattern)}, {k.measured})) AS v, unnest(regexp_split_to_array(t, {q(k.pattern)})[:-2]) AS g, unnest(range(len(regexp_extract_all(t, {q(k.pattern)}, 0)))) AS i FROM docs WHERE regexp_matches(t, {q(k.pattern)})"
        out.append(f"k{i} AS (SELECT r, {i} AS rank, (e - length(m))::BIGINT AS a, e::BIGINT AS b FROM (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) AS e FROM ({got})) WHERE length(v) >= {k.least})")
    roles = "CASE rank " + " ".join(f"WHEN {i} THEN {q(k.role)}" for i, k in enumerate(KINDS)) + " END"
    out.append("parts AS (" + " UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(len(KINDS))) + ")")
    out.append(f"named AS (SELECT *, {roles} AS role, rank < {len(STRONG)} AS strong FROM parts)")
    seen = ", ".join(f"bool_or(o.role = {q(r)}) AS has_{r}" for r in COMPLETE)
    out.append(f"seen AS (SELECT w.r, w.rank, w.a, w.b, w.role, bool_or(o.strong AND o.a < w.b AND o.b > w.a) AS taken, {seen} FROM named w JOIN named o ON o.r = w.r AND o.a <= w.b + {SCOPE} AND o.b + {SCOPE} >= w.a WHERE NOT w.strong GROUP BY ALL)")
    done = " OR ".join(f"(role = {q(r)} AND " + " AND ".join(f"has_{x}" for x in sorted(s)) + ")" for r, sets in COMPLETE.items() for s in sets)
    out.append(f"shown AS (SELECT r, rank, a, b, role, strong FROM named WHERE strong UNION ALL SELECT r, rank, a, b, role, false FROM seen WHERE NOT taken AND ({done}))")
    names = "CASE rank " + " ".join(f"WHEN {i} THEN {q(k)}" for i, k in enumerate(ORDER)) + " END"
    text = f"string_agg({names} || ':' || a || ':' || b, ',' ORDER BY a, rank, b)"
    counts = ", ".join(f"count(*) FILTER (WHERE rank = {i}) AS n_{k}" for i, k in enumerate(STRONG))
    out.append(f"lists AS (SELECT r, {counts}, coalesce({text} FILTER (WHERE strong), '') AS base, {text} AS spans FROM shown GROUP BY r)")
    zero = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in STRONG)
    return "WITH " + ",\n".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in out) + f"\nSELECT doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN lists USING (r)"


OP11_SQL = _sql()
