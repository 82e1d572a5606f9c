"""Personal data: fixed kinds, and identifiers found by bootstrapped contexts. DataFrame functions only.

Base spans are the matches of four patterns. Seed entities are their values, and of the other identifier-like tokens
those in the form of a key: hexadecimal digits in a digest's length (``KEY``). The words on both sides of a value are its
lexical patterns: up to three words before, the word after, and both sides jointly; what has no letter is none. Values and patterns form a graph
that is scored in rounds. A pattern's confidence in a kind, as a value sees it, is the mean score of the pattern's *other*
distinct values, of which ``support`` must have a score: no value vouches for itself. A value's score is the confidence
of its best pattern where that reaches ``least``; seeds stay at 1. Tokens whose best pattern reaches ``least`` after the
last round become spans of kind ``context``, wherever they stand. A key is no exception: it is reported for its contexts
and not for its form.

A match's place follows from the stretches between matches, which ``split`` gives. Runs of one character class are
possessive and start where the run does, so no text makes the patterns slow; an ``\\G`` admits a run that the match
before cut. Offsets are code points, the end exclusive. Places are summed in blocks, and overlaps of tokens with base spans
found by running ends, so that many matches in one text cost little more than in many texts.

Cases: a null text is empty and has no spans; texts are read whole; an identifier has 6 characters or more, a digit among
them, and no longest length; contexts are text, other matches included, and end REACH characters away: of a longer word
the nearer end counts; repeated rows are rows, but a value is one vote for a pattern however often they meet; a null id
is an id; where spans of different kinds overlap all are reported, and masking covers their union; an empty table gives
no rows; input columns pass only if named in ``keep``, and one named like an output is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..session import staged

KINDS = ("email", "ip", "card", "phone")

#: The base patterns; card already asks for 16 to 19 digits, as its runs are maximal.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to match at all.
_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Tokens that may be identifiers: 6 characters or more with a digit.
_TOKEN = "[A-Za-z0-9@._%+/#-]"
CANDIDATE = rf"(?<!{_TOKEN})(?=[A-Za-z@._%+/#-]*+[0-9]){_TOKEN}{{6,}}+(?!{_TOKEN})"

#: Lengths of digests in hexadecimal digits; a letter and a digit must be among them.
KEY = r"^(?=[0-9]*[a-f])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
#: Characters of context on a side, and sums in a block.
REACH, BLOCK = 80, 256

SPAN = "array<struct<kind:string,start:int,end:int>>"


def _found(text: str, pattern: str, needs: str = "") -> tuple[Column, Column]:
    """Matches and the stretches around them; both empty where nothing matches."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if needs:
        hits = F.when(F.contains(F.col(text), F.lit(needs)), hits).otherwise(F.array().cast("array<string>"))
    return hits, F.split(text, pattern, -1)


def _let(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of a value that is computed once however often it is read."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def _running(values: Column, merge: Callable[[Column, Column], Column], first: int = 0) -> Column:
    """Folds of an array's beginnings, each with its last element.

    A fold copies what it holds at every step, so it runs over BLOCK elements and then over the blocks' ends.
    """
    grown = lambda s, v: F.concat(s, F.array(merge(F.get(s, F.size(s) - 1), v)))
    start = F.array(F.lit(first))

    def joined(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda b: F.get(b, F.size(b) - 1))
        before = F.slice(F.aggregate(ends, start, grown), 1, F.size(blocks))
        return F.flatten(F.zip_with(blocks, before, lambda b, at: F.transform(b, lambda v: merge(at, v))))

    def blocked(array: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(array) - 1) / BLOCK).cast("int")))
        return F.transform(at, lambda k: F.slice(F.aggregate(F.slice(array, k * BLOCK + 1, BLOCK), start, grown), 2, BLOCK))

    return _let(values, lambda array: _let(blocked(array), joined))


def _placed(hits: str, gaps: str) -> Column:
    """value, start, end, before and after of every match; before and after are the REACH characters around it."""
    part = lambda array, i: F.coalesce(F.get(array, i), F.lit(""))
    ends = _running(F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.length(h)), lambda a, b: a + b)

    def around(h: Column, i: Column) -> Column:
        # Matches and stretches nearest to the value; a stretch is cut before it is joined.
        before = F.concat(F.right(part(gaps, i - 1), F.lit(REACH)), part(hits, i - 1), part(gaps, i))
        after = F.concat(part(gaps, i + 1), part(hits, i + 1), F.substring(part(gaps, i + 2), 1, REACH))
        return F.struct(
            h.alias("value"), F.right(before, F.lit(REACH)).alias("before"), F.substring(after, 1, REACH).alias("after")
        )

    return F.zip_with(
        F.transform(hits, around), ends,
        lambda m, end: F.struct(
            m["value"].alias("value"), (end - F.length(m["value"])).alias("start"), end.alias("end"),
            m["before"].alias("before"), m["after"].alias("after"),
        ),
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern is one of the kind."""
    if kind == "ip":
        return F.forall(
            F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255)
        )
    if kind == "card":
        return _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _test(kind: str) -> Callable[[Column], Column]:
    return lambda m: _holds(kind, m["value"])


def _named(kind: str, matches: Column) -> Column:
    return F.transform(matches, lambda m: m.withField("kind", F.lit(kind)))


def extract(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` beside rid (a row's number), base spans with contexts by kind, and candidates; written out."""
    kept = [F.col(c) for c in keep if c not in ("rid", "_text")]
    out = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("rid", F.monotonically_increasing_id())
    matched = {k: _found("_text", PATTERNS[k], _NEEDS[k]) for k in KINDS} | {"other": _found("_text", CANDIDATE)}
    out = out.withColumns({f"_{k}_hits": hits for k, (hits, _) in matched.items()})
    none = F.array().cast("array<string>")
    out = out.withColumns({
        f"_{k}_gaps": F.when(F.size(f"_{k}_hits") > 0, gaps).otherwise(none) for k, (_, gaps) in matched.items()
    })
    placed = {k: _placed(f"_{k}_hits", f"_{k}_gaps") for k in matched}
    named = {f"_{k}": _named(k, F.filter(placed[k], _test(k))) for k in KINDS}
    out = out.withColumns(named | {"_other": _named("context", placed["other"])})
    out = out.withColumn("seeds", F.concat(*(F.col(f"_{k}") for k in KINDS)))
    mark = lambda other: lambda m: F.struct(m["start"].alias("start"), F.lit(other).alias("other"), m["end"].alias("end"))
    out = out.withColumn("_marks", F.array_sort(F.concat(F.transform("seeds", mark(1)), F.transform("_other", mark(2)))))
    some = (F.size("seeds") > 0) & (F.size("_other") > 0)
    free = F.transform(F.filter(_apart("_marks"), lambda m: m["other"] == 2), lambda m: m["free"])
    free = F.filter(F.zip_with("_other", free, lambda c, f: F.struct(c.alias("c"), f.alias("f"))), lambda p: p["f"])
    free = F.transform(free, lambda p: p["c"])
    return staged(out.select(*keep, "rid", "seeds", F.when(some, free).otherwise(F.col("_other")).alias("candidates")))


def _apart(marks: str) -> Column:
    """other and free of ``marks`` (start, other, end) in order: whether no base span, other = 1, overlaps a mark."""
    far = 2**31 - 1
    ends = _running(F.transform(marks, lambda m: F.when(m["other"] == 1, m["end"]).otherwise(-1)), F.greatest, -1)
    starts = F.transform(marks, lambda m: F.when(m["other"] == 1, m["start"]).otherwise(far))
    starts = F.reverse(_running(F.reverse(starts), F.least, far))
    held = F.zip_with(marks, ends, lambda m, e: F.struct(m.alias("m"), e.alias("e")))
    return F.zip_with(
        held, starts,
        lambda h, at: F.struct(
            h["m"]["other"].alias("other"), ((h["e"] <= h["m"]["start"]) & (at >= h["m"]["end"])).alias("free")
        ),
    )


def _contexts(rows: DataFrame, spans: str) -> DataFrame:
    """kind, value and pattern of every span, a row for each of its lexical patterns, without repetitions."""
    one = rows.select(F.explode(spans).alias("m")).select(
        F.col("m.kind").alias("kind"), F.lower("m.value").alias("value"),
        F.filter(F.split(F.lower("m.before"), r"\s+"), lambda w: w != "").alias("before"),
        F.get(F.filter(F.split(F.lower("m.after"), r"\s+"), lambda w: w != ""), F.lit(0)).alias("after"),
    )
    last = lambda n: F.when(F.size("before") >= n, F.array_join(F.slice("before", -n, n), " "))
    made = {f"{n} ": last(n) for n in (1, 2, 3)} | {"after ": F.col("after")}
    made |= {f"both {n} ": F.concat(last(n), F.lit(" \t"), F.col("after")) for n in (1, 2)}
    made = [F.when(words.rlike(r"\p{L}"), F.concat(F.lit(name), words)) for name, words in made.items()]
    return one.select("kind", "value", F.explode(F.array_compact(F.array(*made))).alias("pattern")).distinct()


def bootstrap(rows: DataFrame, rounds: int = 3, support: int = 5, least: float = 0.8) -> DataFrame:
    """value and score of the candidate values whose best pattern reaches ``least``. rows: what ``extract`` returns.

    A pattern of any number of values is summed up before it meets them: what the values are joined with is one row for
    each pattern and kind.
    """
    others = _contexts(rows, "candidates").withColumn("kind", F.when(F.col("value").rlike(KEY), "key"))
    edges = _contexts(rows, "seeds").withColumn("open", F.lit(False)).unionByName(others.withColumn("open", F.lit(True)))
    edges = staged(edges)
    total = staged(edges.groupBy("pattern").agg(F.count_distinct("value").alias("values")))
    fixed = edges.where("kind is not null").select("pattern", "value", "kind").distinct().withColumn("own", F.lit(1.0))
    asked = edges.where("open").select("pattern", "value")
    score = None
    for _ in range(rounds):
        known = fixed
        if score is not None:
            free = edges.where("open and kind is null").select("pattern", "value")
            known = fixed.unionByName(free.join(score.withColumnRenamed("score", "own"), "value").select(*fixed.columns))
        mass = known.groupBy("pattern", "kind").agg(F.sum("own").alias("mass"), F.count("*").alias("n"))
        mass = mass.where(F.col("n") >= support).join(total, "pattern")
        seen = asked.join(mass, "pattern").join(known, ["pattern", "value", "kind"], "left")
        rest = F.col("mass") - F.coalesce("own", F.lit(0.0))
        seen = seen.where(F.col("n") - F.col("own").isNotNull().cast("int") >= support)
        seen = seen.select("value", "kind", (rest / (F.col("values") - 1)).alias("score"))
        score = staged(seen.groupBy("value", "kind").agg(F.max("score").alias("score")).where(F.col("score") >= least))
    return score.groupBy("value").agg(F.max("score").alias("score"))


def find(
    docs: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    rounds: int = 3,
    support: int = 5,
    least: float = 0.8,
) -> DataFrame:
    """``keep`` beside base and spans: arrays of (kind, start, end) by kind as listed, then start."""
    rows = extract(docs, text, keep)
    found = bootstrap(rows, rounds, support, least)
    bare = rows.select("rid", F.explode("candidates").alias("m")).select("rid", F.lower("m.value").alias("value"), "m")
    added = (
        bare.join(found.select("value"), "value")
        .groupBy("rid").agg(F.array_sort(F.collect_list(F.struct(F.col("m.start").alias("start"), F.col("m.end").alias("end")))).alias("more"))
    )
    plain = lambda c: F.transform(c, lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    more = F.transform(
        F.coalesce("more", F.array().cast("array<struct<start:int,end:int>>")),
        lambda m: F.struct(F.lit("context").alias("kind"), m["start"].alias("start"), m["end"].alias("end")),
    )
    base = plain("seeds").cast(SPAN)
    return rows.join(added, "rid", "left").select(*keep, base.alias("base"), F.concat(base, more.cast(SPAN)).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str, spans: str) -> Column:
    """The text with every span, or union of spans that overlap, replaced by the first one's kind in square brackets."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("kind"))))
    piece = "array<struct<a:int,b:int,kind:string>>"
    joined = F.aggregate(
        ordered, F.array().cast(piece),
        lambda out, s: F.when(
            (F.size(out) > 0) & (F.element_at(out, -1)["b"] > s["a"]),
            F.concat(
                F.slice(out, 1, F.size(out) - 1),
                F.array(F.element_at(out, -1).withField("b", F.greatest(F.element_at(out, -1)["b"], s["b"]))),
            ),
        ).otherwise(F.concat(out, F.array(s))),
    )
    starts = F.concat(F.transform(joined, lambda s: s["a"]), F.array(F.length(text)))
    ends = F.concat(F.array(F.lit(0)), F.transform(joined, lambda s: s["b"]))
    labels = F.concat(F.transform(joined, lambda s: F.concat(F.lit("["), s["kind"], F.lit("]"))), F.array(F.lit("")))
    kept = F.transform(
        F.arrays_zip(ends.alias("a"), starts.alias("b"), labels.alias("label")),
        lambda p: F.concat(F.substring(F.col(text), p["a"] + 1, p["b"] - p["a"]), p["label"]),
    )
    return F.when(F.size(spans) == 0, F.col(text)).otherwise(F.array_join(kept, ""))
