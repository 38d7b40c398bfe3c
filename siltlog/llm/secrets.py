"""Secret scans with DataFrame functions only: patterns, and Shannon entropy in a sliding window.

Three patterns give the base spans. The entropy scan looks at candidate strings, runs of characters of a class,
and slides a window over each: the sum of c*log2(c) over the counts c of the characters in the window changes by
one step for the character that enters and one for that which leaves, so no window is counted anew. Windows over
the class's threshold that overlap make one span; the ends of a candidate that are too short for a window of their own go
with the span beside them. Spans with a string on the allow-list are dropped, and those inside a base span; spans
that only overlap one stay. Everything is a projection: no row moves, and a text that matches nothing costs the tests only.

Time is in proportion to the text, however long it is and whatever is in it: positions are running sums over blocks,
and long candidates and texts are looked at in chunks.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table

#: Kind, pattern, group whose length counts, least length. In the order in which spans that start together are listed.
#: Where the length is that of the whole match, it is part of the pattern: a run that is too short has no part that isn't.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)


@dataclass(frozen=True)
class CharacterClass:
    """Candidates are runs of these characters; `mixed` are patterns that each must occur in the candidate."""

    name: str
    characters: str
    window: int
    bits: float
    mixed: tuple[str, ...]


CLASSES = (
    CharacterClass("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 24, 4.0, ("[0-9]", "[A-Z]", "[a-z]")),
    CharacterClass("hex", "0123456789ABCDEFabcdef", 24, 3.0, ("[0-9]", "[A-Fa-f]")),
)
#: Spans that match one of these are no secrets: documentation samples, alphabets in order.
ALLOW = (r"(?i)example", r"(?i)0123456789abcdef", r"(?i)abcdefghijklmnop")
#: Elements of a block in a running sum or maximum, and characters of a chunk (a power of two).
BLOCK, CHUNK_BITS = 64, 10
CHUNK = 1 << CHUNK_BITS


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(xs: Column, start: Column, join: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """For each element what join gives from start over all elements before it. Within a block the result is copied
    for each element; blocks are joined by the same means, so that the work per element is bounded."""

    def plain(part: Column, first: Column) -> Column:
        zero = F.struct(first.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(part, zero, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    if not levels:
        return plain(xs, start)

    def over(blocks: Column) -> Column:
        first = running(F.transform(blocks, lambda b: F.aggregate(b, start, join)), start, join, levels - 1)
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("part"), first.alias("first")), lambda z: plain(z["part"], z["first"])))

    def cut(every: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(every) - 1) / BLOCK).cast("int"))
        return F.when(F.size(every) > 0, bound(F.transform(blocks, lambda k: F.slice(every, k * BLOCK + 1, F.lit(BLOCK))), over)).otherwise(F.expr("cast(array() as array<int>)"))

    return bound(xs, cut)


def running_sum(xs: Column) -> Column:
    return running(xs, F.lit(0), lambda a, x: a + x)


def running_max(xs: Column) -> Column:
    return running(xs, F.lit(-1), lambda a, x: F.greatest(a, x))


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut_out(parts: Column, start: Column, end: Column) -> Column:
    """The characters from start to end (exclusive) of the text that the chunks make; walks through their chunks only."""
    first, last = F.shiftright(start, CHUNK_BITS), F.shiftright(end - 1, CHUNK_BITS)

    def within(part: Column, k: Column) -> Column:
        at = F.shiftleft(first + k, CHUNK_BITS)
        a = F.greatest(start - at, F.lit(0))
        return F.substring(part, a + 1, F.least(end - at, F.lit(CHUNK)) - a)

    return F.when(end > start, F.array_join(F.transform(F.slice(parts, first + 1, last - first + 1), within), "")).otherwise(F.lit(""))


def matches(text: Column, pattern: str, group: int = 0, strings: bool = False) -> Column:
    """All non-overlapping matches from the left as structs (start, end, size): code points, and the group's length;
    on request also the matches themselves (s)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(found if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
    kinds = "start:int,end:int,size:int" + ",s:string" * strings

    def placed(steps: Column) -> Column:
        before = running_sum(F.transform(steps, lambda x: x["gap"] + F.coalesce(x["long"], F.lit(0))))

        def span(z: Column) -> Column:
            start, x = z["before"] + z["step"]["gap"], z["step"]
            return F.struct(start.alias("start"), (start + x["long"]).alias("end"), x["size"].alias("size"), *([x["s"].alias("s")] if strings else []))

        return F.filter(F.transform(F.arrays_zip(steps.alias("step"), before.alias("before")), span), lambda m: m["end"].isNotNull())

    steps = [F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(found, F.length).alias("long"), sizes.alias("size")]
    out = bound(F.arrays_zip(*steps, *([found.alias("s")] if strings else [])), placed)
    return F.when(text.rlike(pattern), out).otherwise(F.expr(f"cast(array() as array<struct<{kinds}>>)"))


def _windows(chunk: Column, kind: CharacterClass) -> Column:
    """Spans (start, end) in a chunk whose windows reach the class's entropy, those that meet merged."""
    w, alphabet = kind.window, kind.characters
    c_log_c = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(w + 2)])
    limit = w * (math.log2(w) - kind.bits) + 1e-9  # entropy = log2(w) - total / w
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def step(ch: Column, k: Column) -> Column:
        """A character's place in the counts: eight of a byte each in a long."""
        code = F.instr(F.lit(alphabet), ch) - 1
        return F.struct(k.alias("k"), code.alias("code"), F.shiftright(code, 3).alias("word"), (code.bitwiseAND(7) * 8).alias("shift"))

    def count(counts: Column, x: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, x["word"]), x["shift"]).bitwiseAND(255).cast("int")

    def unit(x: Column, word: Column) -> Column:
        return F.when(x["word"] == word, F.call_function("shiftleft", F.lit(1).cast("long"), x["shift"])).otherwise(F.lit(0).cast("long"))

    def slide(steps: Column):
        def run(acc: Column, x: Column) -> Column:
            leaves = F.get(steps, x["k"] - w)  # null for the first window's characters
            full = x["k"] >= w
            had, lost = count(acc["counts"], x), F.coalesce(count(acc["counts"], leaves), F.lit(1))
            enters = F.get(c_log_c, had + 1) - F.get(c_log_c, had)
            left = F.when(full, F.get(c_log_c, lost - 1) - F.get(c_log_c, lost)).otherwise(F.lit(0.0))
            # when the same character enters and leaves nothing changes
            total = acc["total"] + F.when(full & (leaves["code"] == x["code"]), F.lit(0.0)).otherwise(enters + left)
            counts = F.transform(acc["counts"], lambda c, i: c + unit(x, i) - unit(leaves, i))
            start, end = x["k"] - (w - 1), x["k"] + 1
            last = F.try_element_at(acc["spans"], F.lit(-1))
            merged = F.concat(F.slice(acc["spans"], F.lit(1), F.size(acc["spans"]) - 1), F.array(F.struct(last["start"].alias("start"), end.alias("end"))))
            apart = F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))
            spans = F.when((x["k"] < w - 1) | (total > limit), acc["spans"]).when(last["end"] >= start, merged).otherwise(apart)
            return F.struct(counts.alias("counts"), total.alias("total"), spans.alias("spans"))

        return run

    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-len(alphabet) // 8)).alias("counts"), F.lit(0.0).alias("total"), none.alias("spans"))
    return bound(F.transform(F.split(chunk, ""), step), lambda steps: F.aggregate(steps, zero, slide(steps), lambda acc: acc["spans"]))


def _joined(spans: Column) -> Column:
    """Spans in order of start and end, those that meet merged."""

    def join(every: Column) -> Column:
        first = F.filter(every, lambda x, k: F.coalesce(F.get(every, k - 1)["end"] < x["start"], F.lit(True)))
        last = F.filter(every, lambda x, k: F.coalesce(x["end"] < F.get(every, k + 1)["start"], F.lit(True)))
        return F.transform(F.arrays_zip(first.alias("a"), last.alias("b")), lambda z: F.struct(z["a"]["start"].alias("start"), z["b"]["end"].alias("end")))

    return bound(spans, join)


def windows_over(candidate: Column, kind: CharacterClass, allow: tuple[str, ...] = ALLOW) -> Column:
    """Spans (start, end) in the candidate. It is cut into chunks; each begins all windows that start in it."""
    w, n = kind.window, F.length(candidate)

    def scan(parts: Column) -> Column:
        def of(part: Column, k: Column) -> Column:
            chunk = F.concat(part, F.substring(F.coalesce(F.get(parts, k + 1), F.lit("")), F.lit(1), F.lit(w - 1)))
            return F.transform(_windows(chunk, kind), lambda s: F.struct((s["start"] + k * CHUNK).alias("start"), (s["end"] + k * CHUNK).alias("end")))

        def widened(s: Column) -> Column:
            return F.struct(F.when(s["start"] < w, 0).otherwise(s["start"]).alias("start"), F.when(n - s["end"] < w, n).otherwise(s["end"]).alias("end"))

        def allowed(s: Column) -> Column:
            return bound(cut_out(parts, s["start"], s["end"]), lambda said: functools.reduce(lambda a, b: a | b, [said.rlike(p) for p in allow], F.lit(False)))

        spans = F.transform(_joined(F.flatten(F.transform(parts, of))), widened)
        return F.filter(spans, lambda s: ~allowed(s)) if allow else spans

    return bound(chunks(candidate), scan)


def entropy_spans(text: Column, kind: CharacterClass, allow: tuple[str, ...] = ALLOW) -> Column:
    pattern = f"[{kind.characters}]{{{kind.window},}}"
    kept = F.filter(matches(text, pattern, strings=True), lambda c: functools.reduce(lambda a, b: a & b, [c["s"].rlike(p) for p in kind.mixed]))
    spans = F.transform(kept, lambda c: F.transform(windows_over(c["s"], kind, allow), lambda s: F.struct((c["start"] + s["start"]).alias("start"), (c["start"] + s["end"]).alias("end"))))
    return F.when(text.rlike(pattern), F.flatten(spans)).otherwise(F.expr("cast(array() as array<struct<start:int,end:int>>)"))


def _at_least(size: int):
    return lambda m: m["size"] >= size


def _named(number: int, kind: str):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind_no"), m["end"].alias("end"), F.lit(kind).alias("kind"))


def with_spans(df: DataFrame, classes: tuple[CharacterClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """df, which has a column text without nulls, with n_<kind> of the base kinds, base and added."""
    columns, text = df.columns, F.col("text")
    found = {name: F.transform(F.filter(matches(text, pattern, group), _at_least(least)), _named(k, name)) for k, (name, pattern, group, least) in enumerate(BASE)}
    found |= {f"entropy_{k}": F.transform(entropy_spans(text, kind, allow), _named(len(BASE) + k, f"entropy_{kind.name}")) for k, kind in enumerate(classes)}
    df = df.withColumns(found)
    given, own = [F.col(name) for name, *_ in BASE], [F.col(f"entropy_{k}") for k in range(len(classes))]

    def outside(every: Column) -> Column:
        """Spans in order without the added ones that lie inside a base span, which comes before them."""
        is_base = lambda s: s["kind_no"] < len(BASE)
        covered = running_max(F.transform(every, lambda s: F.when(is_base(s), s["end"]).otherwise(-1)))
        kept = F.filter(F.arrays_zip(every.alias("s"), covered.alias("covered")), lambda z: ~is_base(z["s"]) & (z["covered"] < z["s"]["end"]))
        return F.transform(kept, lambda z: z["s"])

    added = F.when(functools.reduce(lambda a, b: a + b, [F.size(c) for c in own], F.lit(0)) > 0, bound(F.array_sort(F.concat(*given, *own)), outside)).otherwise(F.slice(given[0], 1, 0))
    df = df.withColumns({"base": F.array_sort(F.concat(*given)), "added": added})
    return df.select(*columns, *[F.size(name).cast("long").alias(f"n_{name}") for name, *_ in BASE], "base", "added")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[CharacterClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """One row per input row: id, text, n_<kind>, base and added, arrays of (start, kind_no, end, kind) in that order.

    Positions are code points, ends exclusive. Null and empty texts have no spans; very long texts take time in proportion
    to their length; repeated rows are rows like any other; an empty table gives an empty result; other columns aren't read.
    """
    return with_spans(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), classes, allow)


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex",
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def redacted(text: Column, found: Column, mark: str = "<secret>") -> Column:
    """The text with each span (in order of start) replaced by the mark; overlapping spans share one."""

    def done(every: Column) -> Column:
        before = running_max(F.transform(every, lambda s: s["end"]))  # -1 for the first
        apart = F.filter(F.arrays_zip(every.alias("s"), before.alias("before")), lambda z: z["s"]["start"] >= z["before"])
        last = F.array_max(F.transform(every, lambda s: s["end"]))
        between = lambda parts: F.transform(apart, lambda z: F.concat(cut_out(parts, F.greatest(z["before"], F.lit(0)), z["s"]["start"]), F.lit(mark)))
        return bound(chunks(text), lambda parts: F.concat(F.array_join(between(parts), ""), cut_out(parts, last, F.length(text))))

    return F.when(F.size(found) > 0, bound(found, done)).otherwise(text)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced, and n_chars, if there is such a column, follows.

    Null texts stay null, empty ones empty; very long texts take time in proportion to their length; repeated rows are rows
    like any other; an empty table gives an empty result; other columns, whatever their names, pass through.
    """
    found = with_spans(docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text")))
    found = found.withColumn("clean", redacted(F.col("text"), F.array_sort(F.concat("base", "added"))))
    hit = (F.size("base") + F.size("added")) > 0
    new = {"text": F.when(hit, F.col("clean")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def oracle() -> str:
    """The query in DuckDB's SQL: positions from the pieces between matches, entropy of every window from scratch."""
    lists = ",\n".join(
        f"l{k} AS (SELECT rid, {k} AS kind_no, '{name}' AS kind, regexp_extract_all(t, {p}) AS ms, regexp_extract_all(t, {p}, {group}) AS gs, string_split_regex(t, {p}) AS gaps, {least} AS least FROM d)"
        for k, (name, p, group, least) in enumerate(
            [(name, "'" + pattern.replace("'", "''") + "'", group, least) for name, pattern, group, least in BASE]
            + [(f"entropy_{c.name}", f"'[{c.characters}]{{{c.window},}}'", 0, 0) for c in CLASSES]
        )
    )
    n = len(BASE) + len(CLASSES)
    mixed = " OR ".join(f"(kind = 'entropy_{c.name}' AND " + " AND ".join(f"regexp_matches(s, '{p}')" for p in c.mixed) + ")" for c in CLASSES)
    allowed = " OR ".join(f"regexp_matches(s, '{p}')" for p in ALLOW)
    width = " ".join(f"WHEN 'entropy_{c.name}' THEN {c.window}" for c in CLASSES)
    bits = " ".join(f"WHEN 'entropy_{c.name}' THEN {c.bits}" for c in CLASSES)
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{lists},
m AS (SELECT rid, kind_no, kind, ms[i] AS s, length(gs[i]) AS size, least,
        list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start
      FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM ({" UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(n))}))),
base AS (SELECT rid, kind_no, kind, start, start + length(s) AS stop FROM m WHERE kind_no < {len(BASE)} AND size >= least),
c AS (SELECT *, CASE kind {width} END AS w, CASE kind {bits} END AS bits FROM m
      WHERE kind_no >= {len(BASE)} AND ({mixed}) AND NOT ({allowed} OR len(list_distinct(string_split(s, ''))) = 1)),
win AS (SELECT rid, kind_no, kind, start, w, s AS run, k FROM (SELECT *, unnest(range(0, length(s) - w + 1)) AS k FROM c)
        WHERE list_aggregate(string_split(substr(s, k + 1, w), ''), 'entropy') >= bits - 4e-11),
isl AS (SELECT *, sum(CASE WHEN k - prev <= w THEN 0 ELSE 1 END) OVER (PARTITION BY rid, kind_no, start ORDER BY k) AS island
        FROM (SELECT *, lag(k) OVER (PARTITION BY rid, kind_no, start ORDER BY k) AS prev FROM win)),
ends AS (SELECT rid, kind_no, kind, start, any_value(run) AS run, CASE WHEN min(k) < any_value(w) THEN 0 ELSE min(k) END AS k0,
           CASE WHEN length(any_value(run)) - max(k) - any_value(w) < any_value(w) THEN length(any_value(run)) ELSE max(k) + any_value(w) END AS k1
         FROM isl GROUP BY rid, kind_no, kind, start, island),
added AS (SELECT rid, kind_no, kind, start + k0 AS a, start + k1 AS stop FROM (SELECT *, substr(run, k0 + 1, k1 - k0) AS s FROM ends) WHERE NOT ({allowed})),
found AS (SELECT rid, kind_no, kind, start, stop FROM base
          UNION ALL SELECT rid, kind_no, kind, a, stop FROM added x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = x.rid AND b.start <= x.a AND x.stop <= b.stop)),
texts AS (SELECT *, kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR) AS said FROM found),
docs AS (SELECT rid, count(*) FILTER (kind_no = 0) AS n0, count(*) FILTER (kind_no = 1) AS n1, count(*) FILTER (kind_no = 2) AS n2,
           string_agg(said, ',' ORDER BY start, kind_no, stop) FILTER (kind_no < {len(BASE)}) AS base_said, string_agg(said, ',' ORDER BY start, kind_no, stop) AS spans FROM texts GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base_said, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN docs USING (rid)"""
