"""Personal data: exact base spans, and information-theoretic sanitisation of the terms that give them away.

Base spans are the protected entities. How strongly a term t reveals an entity c is estimated from co-occurrence in the
corpus: PMI(c; t) against the information content IC(c) = -log p(c). A token has c near if one of its spans stands within WINDOW
terms of it on a line; p(c) is the share of the corpus' tokens that have c near, p(c|t) that of the tokens t and one more that has
not: a term seen only once or twice proves less, and one that also stands elsewhere is soon none. Then
PMI(c; t) = IC(c) + log p(c|t), and t discloses c from ``disclosure`` times IC(c) on. A term that discloses some entity is generalised
wherever it stands in any text, and removed from ``removal`` times IC(c) on. Everything is built of DataFrame functions.

No base pattern matches a newline, so a text's matches are those of its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, saved

#: Kinds in their order.
KINDS = ("email", "ip", "card", "phone")

#: As the base patterns, but each start that must fail where an earlier one of its run failed is skipped (a start within a run of
#: the first class counts only at the run's start or where the last match ended), and runs are not given back: time stays linear.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a valid match certainly has.
HINTS = {"email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TERM = r"\p{L}{3,}+"
#: Terms on each side of an entity that are near it.
WINDOW = 10

SPAN = "array<struct<s:bigint,e:bigint,value:string>>"
#: Items of a list that are gone through at a time; forms of words up to which a pattern of them alone is looked for in a text.
BLOCK, FORMS = 128, 64


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def let(value: Column, body) -> Column:
    """``body(value)`` with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocks(items: Column) -> Column:
    """The items as a list of lists of BLOCK."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, BLOCK))
    return F.when(F.size(items) > 0, cut).otherwise(F.slice(F.array(items), 1, 0))


def placed(items: Column) -> Column:
    """``array<struct<s, e, value>>`` of ``array<struct<gap, hit>>``: where each hit stands if ``gap`` characters lie between it and the hit before.

    A list that grows is copied at each item, so it grows only to BLOCK items, and the list of such lists by one at each block.
    """
    none = F.array().cast(SPAN)

    def place(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"), x["hit"].alias("value")))).alias("out"))

    def step(acc, block):
        last = F.aggregate(block, F.struct(acc["last"]["at"].alias("at"), none.alias("out")), place)
        return F.struct(last.alias("last"), F.concat(acc["all"], F.array(acc["last"]["out"])).alias("all"))

    zero = F.struct(F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")).alias("last"), F.array().cast(f"array<{SPAN}>").alias("all"))
    return let(items, lambda xs: F.flatten(F.aggregate(blocks(xs), zero, step, lambda acc: F.concat(acc["all"], F.array(acc["last"]["out"])))))


def matches(text: Column, pattern: str | Column) -> Column:
    """``array<struct<s, e, value>>``: the matches of a pattern with their code point offsets."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    hits, between = F.regexp_extract_all(text, pattern, 0), F.split(text, pattern, -1)
    both = F.zip_with(between, hits, lambda g, h: F.struct(F.length(g).cast("long").alias("gap"), h.alias("hit")))
    return placed(F.filter(both, lambda x: x["hit"].isNotNull()))  # the last gap has no hit


def base_matches(text: Column, kind: str) -> Column:
    found = F.when(F.contains(text, F.lit({"email": "@", "ip": ".", "card": "", "phone": "+"}[kind])) & text.rlike(HINTS[kind]), F.filter(matches(text, PATTERNS[kind]), lambda x: _valid(kind, x["value"])))
    return F.coalesce(found, F.array().cast(SPAN))


def listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def digest(text: Column) -> Column:
    """Column: 128 bits that stand for a text; null as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def base_spans(docs: DataFrame) -> DataFrame:
    """docs, ``email, ip, card, phone`` (the spans of each kind), ``_fl_row`` (a row number), ``_fl_of`` (the text's digest) and ``_fl_terms`` (its number of terms)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumns({k: base_matches(text, k) for k in KINDS})
    return out.withColumns({"_fl_terms": F.regexp_count(text, F.lit(TERM)).cast("long"), "_fl_row": F.monotonically_increasing_id(), "_fl_of": digest(text)})


def entity_lines(text: Column) -> Column:
    """``array<struct<s, e, value>>``: the lines that may hold an entity."""
    lines = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(F.when(i == 0, 0).otherwise(1).cast("long").alias("gap"), line.alias("hit")))
    return F.filter(placed(lines), lambda x: x["value"].rlike("|".join(HINTS.values())))


def entities() -> Column:
    """``array<struct<key, s, e>>`` of the spans of all kinds; the key is what entities that are the same share."""
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    clean = {"email": F.lower, "ip": lambda v: v, "card": digits, "phone": digits}
    key = lambda k: lambda x: F.struct(F.concat(F.lit(k + ":"), clean[k](x["value"])).alias("key"), x["s"].alias("s"), x["e"].alias("e"))
    return F.concat(*(F.transform(k, key(k)) for k in KINDS))


#: What an event of a text is, in the order of events of one place.
LINE, ENTITY, TOKEN = 0, 1, 2


def in_order(events: DataFrame, text: str) -> DataFrame:
    """``events(<text>, kind, s, e, ...)`` in the order of places, with ``free`` (a token that overlaps no entity), ``line`` (where its line begins) and ``n`` (free tokens so far).

    A token that lies over an entity's start is right before it; one that lies behind it starts before the furthest end so far.
    """
    order = Window.partitionBy(text).orderBy("s", "kind")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    entity = F.col("kind") == ENTITY
    events = events.withColumns({
        "_end": F.max(F.when(entity, F.col("e"))).over(so_far),
        "_next": F.lead(F.when(entity, F.col("s"))).over(order),
        "line": F.max(F.when(F.col("kind") == LINE, F.col("s"))).over(so_far),
    })
    free = (F.col("kind") == TOKEN) & (F.coalesce("_end", F.lit(0)) <= F.col("s")) & (F.coalesce("_next", F.col("e")) >= F.col("e"))
    return events.withColumn("free", free).drop("_end", "_next").withColumn("n", F.count_if("free").over(so_far))


def near_terms(base: DataFrame) -> DataFrame:
    """``row, entity, term, s, e`` of every token within WINDOW terms of an entity on its line, from ``base(row, entities, lines)``.

    Tokens are numbered along their text and joined to entities by their number: the work is that of sorting them, however long a line is.
    """
    lines = base.select("row", F.explode("lines").alias("l"))
    tokens = lines.select("row", F.col("l.s").alias("at"), F.explode(matches(F.col("l.value"), TERM)).alias("t"))
    nothing = F.lit(None).cast("string")
    events = lines.select("row", F.lit(LINE).alias("kind"), F.col("l.s").alias("s"), F.col("l.e").alias("e"), nothing.alias("value"))
    events = events.unionByName(tokens.select("row", F.lit(TOKEN).alias("kind"), (F.col("at") + F.col("t.s")).alias("s"), (F.col("at") + F.col("t.e")).alias("e"), F.lower("t.value").alias("value")))
    own = base.select("row", F.explode("entities").alias("c"))
    events = events.unionByName(own.select("row", F.lit(ENTITY).alias("kind"), "c.s", "c.e", F.col("c.key").alias("value")))
    events = saved(in_order(events, "row").where(f"free or kind = {ENTITY}"), "pii-events")
    around = events.where(f"kind = {ENTITY}").select("row", "line", F.col("value").alias("entity"), F.explode(F.sequence(F.col("n") - (WINDOW - 1), F.col("n") + WINDOW)).alias("n"))
    return around.join(events.where("free").select("row", "line", "n", F.col("value").alias("term"), "s", "e"), ["row", "line", "n"]).select("row", "entity", "term", "s", "e").distinct()


def disclosing(near: DataFrame, docs: DataFrame, n_terms: int, disclosure: float, removal: float) -> DataFrame:
    """``entity, term, ratio, action`` of the terms that disclose an entity; an entity that was seen once is rated like any other."""
    pairs = saved(near.groupBy("entity", "term").agg(F.count("*").alias("together")), "pii-pairs")
    close = near.groupBy("entity").agg(F.count("*").alias("close"))
    terms = bounded(saved(pairs.select("term").distinct(), "pii-terms"))
    corpus = docs.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TERM), 0)).alias("t")).select(F.lower("t").alias("term"))
    # counted before they are joined: what moves is a row for each task and word, not each token
    frequency = corpus.groupBy("term").agg(F.count("*").alias("all")).join(terms, "term", "left_semi")
    content = -F.log(F.least(F.col("close") / float(max(n_terms, 1)), F.lit(1.0)))
    rated = pairs.join(frequency, "term").join(close, "entity")
    rated = rated.withColumn("ratio", F.when(content > 0, 1 + F.log(F.col("together") / (F.col("all") + 1.0)) / content).otherwise(F.lit(0.0)))
    action = F.when(F.col("ratio") >= removal, "remove").otherwise("generalise")
    return saved(rated.where(F.col("ratio") >= disclosure).select("entity", "term", "ratio", action.alias("action")), "pii-disclosing")


def marked(docs: DataFrame, base: DataFrame, terms: DataFrame) -> DataFrame:
    """``of, terms array<struct<action, s, e>>``: by the digest of a text, every token of it that is one of ``terms(term, action)`` and overlaps no base span."""
    terms = bounded(terms)
    text = F.coalesce(F.col("text"), F.lit(""))
    forms = docs.select(digest(text).alias("of"), F.explode(F.regexp_extract_all(text, F.lit(TERM), 0)).alias("form")).withColumn("term", F.lower("form"))
    having = forms.join(terms, "term", "left_semi").groupBy("of").agg(F.array_sort(F.collect_set("form")).alias("forms"))
    # few words are looked for alone, so that few matches are placed; with many, all words of a text are
    alone = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join("forms", "|"), F.lit(r")(?!\p{L})"))
    having = saved(having.select("of", F.when(F.size("forms") <= FORMS, alone).otherwise(F.lit(TERM)).alias("pattern")), "pii-having")
    having = bounded(having)
    held = docs.select(digest(text).alias("of"), text.alias("text")).join(having, "of").groupBy("of").agg(F.first("text").alias("text"), F.first("pattern").alias("pattern"))
    tokens = held.select("of", F.explode(matches(F.col("text"), F.col("pattern"))).alias("t"))
    tokens = tokens.select("of", "t.s", "t.e", F.lower("t.value").alias("term")).join(terms, "term").select("of", F.lit(TOKEN).alias("kind"), "s", "e", "action")
    spans = base.where(F.size("entities") > 0).select(F.col("_fl_of").alias("of"), "entities").join(having, "of", "left_semi").dropDuplicates(["of"])
    spans = spans.select("of", F.explode("entities").alias("c")).select("of", F.lit(ENTITY).alias("kind"), "c.s", "c.e", F.lit(None).cast("string").alias("action"))
    free = in_order(tokens.unionByName(spans), "of").where("free")
    return free.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("action", "s", "e"))).alias("terms"))


def found(docs: DataFrame, disclosure: float = 0.9, removal: float = 0.95, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of docs, the base spans ``email, ip, card, phone`` and ``terms array<struct<action, s, e>>``, the spans that the method adds.

    Null text is as empty: no spans. Every occurrence of a disclosing term is a span, in any text, on any line; of two
    entities that it discloses ``remove`` counts. Added spans never overlap base spans or each other.
    Repeated rows have theirs each; an empty table gives no rows; extra columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = base_spans(docs.select(*dict.fromkeys([*keep, "text"]))).withColumn("entities", entities())
    base = base.withColumn("lines", F.when(F.size("entities") > 0, entity_lines(text)))
    base = base if "text" in keep else base.drop("text")
    base = saved(base, "pii-base")
    near = saved(near_terms(base.where("lines is not null").select(F.col("_fl_row").alias("row"), "entities", "lines")), "pii-near")
    n_terms = base.agg(F.sum("_fl_terms")).first()[0] or 0
    flagged = disclosing(near, docs, n_terms, disclosure, removal)
    terms = saved(flagged.groupBy("term").agg(F.max("action").alias("action")), "pii-marks")
    added = saved(marked(docs, base, terms), "pii-marked")
    out = base.join(bounded(added), F.col("_fl_of") == F.col("of"), "left")
    none = F.array().cast("array<struct<action:string,s:bigint,e:bigint>>")
    return out.select(*keep, *KINDS, F.coalesce("terms", none).alias("terms"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with its spans ``array<struct<kind, s, e>>``, none overlapping, replaced: ``[KIND]``, or nothing for kind ``remove``.

    The text is cut once for each BLOCK of spans, and such a part for each of its spans.
    """
    mark = lambda x: F.when(x["kind"] == "remove", "").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
    cut = lambda t, start, end: F.substring(t, (start + 1).cast("int"), (end - start).cast("int"))

    def part(block):
        first = F.element_at(block, 1)["after"]
        return let(cut(text, first, F.element_at(block, -1)["s"]), lambda own: F.array_join(F.transform(block, lambda x: F.concat(cut(own, x["after"] - first, x["s"] - first), mark(x))), ""))

    def whole(xs):
        ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(xs, lambda x: x["e"]))
        items = F.transform(xs, lambda x, i: F.struct(F.element_at(ends, i + 1).alias("after"), x["s"].alias("s"), x["kind"].alias("kind")))
        return F.concat(let(items, lambda ys: F.array_join(F.transform(blocks(ys), part), "")), F.substring(text, (F.element_at(ends, -1) + 1).cast("int"), F.length(text)))

    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return let(ordered, whole)


def sanitised_documents(docs: DataFrame, disclosure: float = 0.9, removal: float = 0.95) -> DataFrame:
    """``doc_id, text``: whole texts with base spans and disclosing terms replaced. A card's digits may be a phone's too: the first kind counts.

    Null texts stay null; else as ``found``.
    """
    rows = found(docs, disclosure, removal, keep=("doc_id", "text"))

    def named(kind):
        return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))

    def apart(spans, taken):
        return F.filter(spans, lambda x: ~F.exists(taken, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])))

    terms = F.transform("terms", lambda x: F.struct(F.when(x["action"] == "remove", "remove").otherwise("term").alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    taken = named(KINDS[0])
    for spans in (*map(named, KINDS[1:]), terms):
        taken = F.concat(taken, apart(spans, taken))
    return rows.select("doc_id", sanitised(F.col("text"), taken).alias("text"))
