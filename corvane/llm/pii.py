"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Patterns find e-mail and IP addresses, card and phone numbers. These values are the protected entities: corpus counts
estimate how much each term in their sentences reveals. With n distinct texts, the information content of an entity
is log2(n / n_entity), and what a term tells of it is their pointwise mutual information
log2(n * n_both / (n_entity * n_term)). A term whose share of the entity's information reaches a threshold is generalised
or removed wherever it stands (Sanchez and Batet, "C-sanitized", 2016). As few texts prove little, the share must reach
the threshold with the lower Wilson bound in place of n_both / n_term too; so entities met once are judged like others.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import keep, table, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the kinds' patterns: they match the same, but need no stack for long runs and try each run once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Standard deviations of the Wilson bound; shares of an entity's information from which a term is generalised and removed.
DEVIATIONS, GENERALISE, REMOVE = 1.0, 0.75, 0.9
#: Where sentences end.
SENTENCE = r"(?<=[.!?])\s+|\n+"
TERM = r"\p{L}[\p{L}\p{Nd}]{2,}+"
PLACE = "struct<start:int,end:int,value:string>"
#: What a text must have for a pattern to match; cheaper than the pattern.
_CHANCE = {
    "email": lambda text: text.contains("@"), "ip": lambda text: text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
    "card": lambda text: text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": lambda text: text.contains("+"),
}
_PART = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.split(F.regexp_replace(value, "[^0-9]", ""), ""))
    double = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    parts = F.transform(digits, lambda d, i: F.when(i % 2 == 1, double(d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, place: Column) -> Column:
    value = place["value"]
    digits = F.regexp_count(value, F.lit("[0-9]"))
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": digits.between(13, 19) & _luhn(value),
        "phone": digits.between(9, 15),
    }[kind]


def _once(value: Column, f) -> Column:
    """f(value), with `value` computed once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _in_parts(items: Column) -> Column:
    """`items` in slices of about the square root of their number, so that folds which append copy little."""

    def cut(xs: Column) -> Column:
        size = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(xs))).cast("int"))
        last = F.floor((F.greatest(F.size(xs), F.lit(1)) - 1) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(xs, i * size + 1, size))

    return _once(items, cut)


def scan(items: Column, start: Column, out: str, step) -> Column:
    """Outputs of a fold over `items`: step(state, item) gives the next state and an output of type `out`."""

    def one(acc: Column, x: Column) -> Column:
        state, made = step(acc["at"], x)
        return F.struct(state.alias("at"), F.concat(acc["out"], F.array(made)).alias("out"))

    def part(acc: Column, xs: Column) -> Column:
        done = F.aggregate(xs, F.struct(acc["at"].alias("at"), F.array().cast(f"array<{out}>").alias("out")), one)
        return _once(done, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    zero = F.struct(start.alias("at"), F.array().cast(f"array<array<{out}>>").alias("out"))
    return F.flatten(F.aggregate(_in_parts(items), zero, part, lambda acc: acc["out"]))


def placed(text: Column, pattern: Column, hits: Column) -> Column:
    """Places (start, end, value) of `hits`, all matches of `pattern`, from the lengths of what lies between them."""
    none = F.array().cast(f"array<{PLACE}>")
    gaps = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(hits), F.lit(1))), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        end = start + F.length(x["hit"])
        return end, F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value"))

    return F.when(F.size(hits) > 0, scan(gaps, F.lit(0), PLACE, step)).otherwise(none)


def base_spans(docs: DataFrame) -> DataFrame:
    """`docs` with an array column _<kind> of places for each kind (null text: empty)."""
    found = lambda k, p: F.when(_CHANCE[k](text_or_empty()), F.regexp_extract_all(text_or_empty(), F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>"))
    hits = {f"_hits_{k}": found(k, p) for k, p in PATTERNS.items()}
    rows = docs.withColumns(hits)
    rows = rows.withColumns({f"_{k}": F.filter(placed(text_or_empty(), F.lit(p), F.col(f"_hits_{k}")), partial(_valid, k)) for k, p in PATTERNS.items()})
    return rows.drop(*hits)


def _key() -> Column:
    return F.xxhash64(text_or_empty())


def _entity(kind: str, x: Column) -> Column:
    """One key for all spellings: addresses in lower case, others by their digits."""
    value = F.lower(x["value"])
    if kind == "ip":
        value = F.regexp_replace(value, r"(?<![0-9])0+(?=[0-9])", "")
    elif kind != "email":
        value = F.regexp_replace(value, "[^0-9]", "")
    return F.xxhash64(F.lit(kind), value)


def _wilson(k: Column, n: Column) -> Column:
    """Lower bound of a share of which k of n cases are seen."""
    z, p = DEVIATIONS, k / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def disclosing_terms(docs: DataFrame) -> DataFrame | None:
    """(term, share) of the terms that reveal an entity, over all distinct texts of `docs`; None if there is none.

    A term meets an entity where both stand in one sentence. Equal texts count once, so copies prove nothing and hide
    nothing.
    """
    # keys come before sentences and words: made after, they would put a copy of the whole text beside each of them
    said = docs.select(_key().alias("key"), F.split(text_or_empty(), SENTENCE).alias("parts")).select("key", F.explode("parts").alias("text")).where(F.col("text").rlike("[@0-9]"))
    entities = F.array_distinct(F.concat(*(F.transform(f"_{k}", partial(_entity, k)) for k in KINDS)))
    terms = F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace("text", PATTERNS["email"], " ")), F.lit(TERM), F.lit(0)))
    near = keep(base_spans(said).select("key", entities.alias("entities"), terms.alias("terms")).where(F.size("entities") > 0))
    near = near.select("key", F.explode("entities").alias("entity"), "terms")
    alone = near.select("entity", "key").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    both = near.select("entity", "key", F.explode("terms").alias("term")).distinct().groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    # entities with the same counts are one row, so a word beside every entity gathers nowhere
    candidates = keep(both.join(alone, "entity").select("term", "n_both", "n_entity").distinct())
    if candidates.isEmpty():
        return None
    texts = docs.select(_key().alias("key"), text_or_empty().alias("text")).dropDuplicates(["key"])
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    # words are summed up before they are shuffled or joined, so a word in every text gathers nowhere
    with_term = words.groupBy("term").agg(F.count("*").alias("n_term"))
    n = docs.select(_key().alias("key")).distinct().count()
    whole = F.log2(F.lit(float(n)) / F.col("n_entity"))
    share = lambda p: F.when(whole > 0, F.least((whole + F.log2(p)) / whole, F.lit(1.0))).otherwise(0.0)
    told = candidates.join(with_term, "term").where(share(_wilson(F.col("n_both"), F.col("n_term"))) >= GENERALISE)
    found = keep(told.groupBy("term").agg(F.max(share(F.col("n_both") / F.col("n_term"))).alias("share")))
    return None if found.isEmpty() else found


def _outside(terms: Column, base: Column) -> Column:
    """Those of the ordered `terms` that overlap no place of `base`: one pass over both in order of their starts."""
    row = lambda kind: lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("term"), x["end"].alias("end"), x["value"].alias("value"))
    both = F.array_sort(F.concat(F.transform(base, row(0)), F.transform(terms, row(1))))

    def step(reach: Column, x: Column) -> tuple[Column, Column]:
        free = (x["x"]["term"] == 1) & (x["x"]["start"] >= reach) & (x["next"].isNull() | (x["next"] >= x["x"]["end"]))
        return F.when(x["x"]["term"] == 1, reach).otherwise(F.greatest(reach, x["x"]["end"])), F.when(free, F.struct(x["x"]["start"].alias("start"), x["x"]["end"].alias("end"), x["x"]["value"].alias("value")))

    # terms never overlap each other, so whatever starts next settles whether a base place overlaps from the right
    ahead = lambda both: F.transform(both, lambda x, i: F.struct(x.alias("x"), F.get(both, i + 1)["start"].alias("next")))
    return F.filter(scan(_once(both, ahead), F.lit(0), PLACE, step), lambda x: x.isNotNull())


def all_spans(docs: DataFrame) -> DataFrame:
    """`docs` with arrays _email, _ip, _card, _phone and _term of places (start, end, value), as code points.

    _term holds the disclosing terms outside the other spans; its value is "generalise" or "remove". Null texts have no
    place. Columns of `docs` with these names are replaced.
    """
    terms, found = disclosing_terms(docs), base_spans(docs)
    none = F.array().cast(f"array<{PLACE}>")
    if terms is None:
        return found.withColumn("_term", none)
    words = docs.select(_key().alias("_key"), F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty()), F.lit(TERM), F.lit(0))).alias("words")).select("_key", F.explode("words").alias("term"))
    # its rows grow with the corpus, so it is never broadcast
    in_text = keep(words.join(terms, "term").groupBy("_key").agg(F.map_from_entries(F.collect_set(F.struct("term", "share"))).alias("_shares")))
    found = found.withColumn("_key", _key()).join(in_text.hint("shuffle_merge"), "_key", "left")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{Nd}])(?iu:"), F.array_join(F.map_keys("_shares"), "|"), F.lit(r")(?![\p{L}\p{Nd}])"))
    found = found.withColumn("_pattern", F.coalesce(pattern, F.lit("(?!)")))
    found = found.withColumn("_hits", F.when(F.col("_shares").isNotNull(), F.call_function("regexp_extract_all", text_or_empty(), F.col("_pattern"), F.lit(0))).otherwise(F.array().cast("array<string>")))
    found = found.withColumn("_places", placed(text_or_empty(), F.col("_pattern"), F.col("_hits")))
    base = F.concat(*(F.col(f"_{k}") for k in KINDS))
    free = F.when(F.size("_places") > 0, _outside(F.col("_places"), base)).otherwise(none)
    act = lambda x: F.when(F.element_at("_shares", F.lower(x["value"])) >= REMOVE, "remove").otherwise("generalise")
    return found.withColumn("_term", F.transform(free, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), act(x).alias("value")))).drop("_key", "_shares", "_pattern", "_hits", "_places")


def replaced(text: Column, spans: Column) -> Column:
    """`text` with each span (start, last = -end, by) replaced; what overlaps an earlier span goes with that one.

    Spans are in order. The text is cut once for each part of them, so that no cut begins at the front for every span.
    """

    def part(acc: Column, xs: Column) -> Column:
        reach = F.greatest(acc["at"], F.array_max(F.transform(xs, lambda x: -x["last"])))
        cut = F.struct(acc["at"].alias("base"), F.substring(text, acc["at"] + 1, reach - acc["at"]).alias("block"))

        def fold(c: Column) -> Column:
            def one(a: Column, x: Column) -> Column:
                free = x["start"] >= a["at"]
                more = F.concat(F.substring(c["block"], a["at"] - c["base"] + 1, x["start"] - a["at"]), x["by"])
                return F.struct(F.greatest(a["at"], -x["last"]).alias("at"), F.when(free, F.concat(a["out"], F.array(more))).otherwise(a["out"]).alias("out"))

            return F.aggregate(xs, F.struct(c["base"].alias("at"), F.array().cast("array<string>").alias("out")), one)

        return _once(_once(cut, fold), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(r["out"], ""))).alias("out")))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(_in_parts(spans), zero, part, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def sanitise(docs: DataFrame) -> DataFrame:
    """`docs` with personal data replaced by its kind in brackets, and disclosing terms by [term] or nothing.

    Of spans that overlap, the first to start counts, and the longer of two; what another has beyond it goes too. Null
    texts stay null and empty ones empty; n_chars, if there is such a column, is that of the new text. Texts of any
    length are read whole, in time about linear in their hits. Rows, repeated ones too, their columns and the columns'
    order stay, whatever the names; an empty table stays empty.
    """
    found = all_spans(docs.select(F.struct("*").alias("row"), "text"))
    by = lambda k, x: F.when(x["value"] == "remove", F.lit("")).otherwise(F.lit("[term]")) if k == "term" else F.lit(f"[{k}]")
    mark = lambda k: F.transform(f"_{k}", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("last"), by(k, x).alias("by")))
    found = found.withColumn("_spans", F.array_sort(F.concat(*(mark(k) for k in (*KINDS, "term")))))
    found = found.withColumn("_new", replaced(F.col("text"), F.col("_spans")))
    named = {"text": F.col("_new").alias("text"), "n_chars": F.length("_new").cast(dict(docs.dtypes).get("n_chars", "long")).alias("n_chars")}
    return found.select(*(named.get(c, F.col("row").getField(c).alias(c)) for c in docs.columns))


def op4_pii_sanitise(spark, sf_dir: str) -> DataFrame:
    """The spans of every document by the contract: counts and digest of the base, all spans, and the number of terms.

    A null or empty text has no span, and repeated rows are each returned; an empty table gives no row.
    """
    found = all_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    name = lambda k, x: F.concat_ws(":", F.lit(k), x["start"], x["end"])
    named = {k: F.transform(f"_{k}", partial(name, k)) for k in (*KINDS, "term")}
    base = F.array_join(F.concat(*(named[k] for k in KINDS)), ",")
    spans = F.array_join(F.concat(*named.values()), ",")
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in (*KINDS, "term")]
    return found.select("doc_id", *counts[:4], F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"), counts[4])
