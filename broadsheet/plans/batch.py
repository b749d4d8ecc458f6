"""All saved queries over the corpus in one pass.

The clause table holds ``(query_id, node, alt, grp, neg, field, kind, pattern, distance)``. Node 0
is the query itself; it is a disjunction of alternatives, and an alternative is a set of groups,
each of which needs one hit, and of negated groups, which must have none. A leaf of kind ``node``
stands for a sub-clause with rows of its own under a larger number, so a table grows with the
text of its queries, however they are nested. ``node`` may be left out where all is node 0.

Every group becomes a bit. Words (and word sequences, for phrases) of the articles are
joined to the clause table on equality, hits are or-ed together per query and article, and
the bits are then carried from the innermost sub-clauses to the query. Words that no query
uses fall out before the join, by a bitmap of fixed size. Nothing but hits is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clauses import Clause, clause_rows
from ..functions.tokens import (
    analyzed_pieces,
    analyzed_positions,
    is_stop_word,
    is_word,
    joined,
    stripped_pieces,
)
from ..operators.counts import token_count
from ..operators.filters import date_between, size_gate
from ..schema import ALL, CLOUD_FIELDS, DATE, ID, SEARCH_FIELDS, SEARCH_TEXT, SPATIAL, STORED_WORDS, SUBJECT
from ..session import durable
from ..sources.saved_queries import with_labels
from .expand import expand, expand_lengths

CLAUSE_COLUMNS = (
    "query_id int, node int, alt int, grp int, neg boolean, field string, kind string, "
    "pattern string, distance int"
)
_BITS = 62
#: Bits of the map of words in use. It only saves work, and has this size for any table.
_MAP_BITS = 1 << 18
#: A key with more than 1 / (_FINE x shuffle partitions) of all rows is split, so that no partition is
#: made of a few large pieces; and so many keys can be split at most.
_FINE, _MOST_SPLIT = 32, 100_000
#: Beyond the broadcast threshold so many rows of the lookup are broadcast all the same: whole scopes
#: with few rows, and the words that are most frequent in the articles, whether a query has them or not.
_HELD = 300_000
_PATTERN_KINDS = ("wildcard", "fuzzy")
_PATTERN = ["kind", "pattern", "distance"]
# What stands after the field in a scope: one word, any word at all, the length of a word.
_WORD, _SOME, _LENGTH = "1", "some", "length"


@dataclass(frozen=True)
class SavedQuery:
    id: int
    clause: Clause
    date_lower: date
    date_upper: date
    exclude_article_type: tuple[str, ...] = ()
    exclude_distributions: tuple[str, ...] = ()
    user_id: int = 0
    query: str = ""


def query_tables(spark: SparkSession, saved: list[SavedQuery]) -> tuple[DataFrame, DataFrame]:
    """The saved-query table and the clause table for queries written in Python."""
    queries, clauses = [], []
    for q in saved:
        queries.append(
            (q.id, q.query, q.date_lower, q.date_upper, list(q.exclude_article_type),
             list(q.exclude_distributions), q.user_id)
        )
        for row in clause_rows(q.clause):
            leaf = row.leaf
            clauses.append(
                (q.id, row.node, row.alt, row.grp, row.neg, leaf.field, leaf.kind, leaf.pattern, leaf.distance)
            )
    schema = (
        "id int, query string, date_lower date, date_upper date, "
        "exclude_article_type array<string>, exclude_distributions array<string>, user_id int"
    )
    return spark.createDataFrame(queries, schema), spark.createDataFrame(clauses, CLAUSE_COLUMNS)


def phrase_pattern(text: Column) -> Column:
    """A phrase as the clause table holds it: stop words empty, none at either end."""
    return F.trim(F.array_join(analyzed_positions(text), " "))


@dataclass
class CompiledQueries:
    """Small tables that the pass over the articles needs."""

    lookup: DataFrame  # scope, key -> query_id, word, bit
    rules: DataFrame  # query_id -> filters, and the steps of its program
    scopes: list[str] = field(default_factory=list)
    words: int = 1
    vocabulary: DataFrame | None = None  # term, n; read beyond the broadcast threshold only
    used: Column | None = None  # the bitmap of words, as an array of 64-bit numbers
    starts: Column | None = None  # the same of the first words of phrases, which are far fewer
    date_lower: date | None = None
    date_upper: date | None = None


def compile_queries(queries: DataFrame, clauses: DataFrame, vocabulary: DataFrame) -> CompiledQueries:
    """Resolve clauses to keys and number their groups.

    ``vocabulary`` holds the words of the articles that are searched (``corpus_vocabulary``); it
    is read only if there are patterns, or a lookup beyond the broadcast threshold. The tables are stored, so that Catalyst knows their
    sizes, and a join with the articles is broadcast only if the stored table is small.
    """
    clauses = durable(_numbered(_analysed(clauses)))
    word = F.floor(F.col("slot") / _BITS).cast("int").alias("word")
    # One row for each phrase shape, pattern kind and mask word: bounded by what users type.
    rows = clauses.select("scope", "kind", word).distinct().collect()
    words = max((r["word"] for r in rows), default=0) + 1

    columns = ["scope", "key", "query_id", "slot"]
    leaves = clauses.where(F.col("kind") != "node")
    keys = leaves.where(~F.col("kind").isin(*_PATTERN_KINDS)).withColumn("key", F.col("pattern")).select(columns)
    if any(r["kind"] in _PATTERN_KINDS for r in rows):
        patterns = durable(leaves.where(F.col("kind").isin(*_PATTERN_KINDS)))
        vocabulary = durable(vocabulary)  # one pass over the texts, however often it is read
        literal = (F.col("kind") == "fuzzy") | F.rlike("pattern", F.lit("[^*?]"))
        marks = ~literal & F.contains(F.col("pattern"), F.lit("?"))
        terms = expand(patterns.where(literal), vocabulary).withColumnRenamed("term", "key")
        lengths = expand_lengths(patterns.where(marks), vocabulary)
        as_scope = lambda name: F.concat_ws("/", "field", F.lit(name))
        keys = (
            keys.unionByName(patterns.join(terms, _PATTERN).select(columns))
            .unionByName(
                patterns.join(lengths, _PATTERN).withColumn("scope", as_scope(_LENGTH)).select(columns)
            )
            .unionByName(
                patterns.where(~literal & ~marks)
                .withColumns({"scope": as_scope(_SOME), "key": F.lit("")})
                .select(columns)
            )
        )
    lookup = keys.distinct().select(
        "scope",
        "key",
        "query_id",
        F.floor(F.col("slot") / _BITS).cast("int").alias("word"),
        _bit(F.col("slot")).alias("bit"),
    )
    rules = durable(with_labels(queries).join(_rules(clauses, words), "query_id"))
    # A query that no hit at all satisfies must see every article.
    no_hit = F.array(*[F.lit(0).cast("bigint")] * words)
    bare = rules.where(_holds(no_hit, words)).select(
        F.lit("doc").alias("scope"), F.lit("").alias("key"), "query_id",
        F.lit(0).alias("word"), F.lit(0).cast("bigint").alias("bit"),
    )
    # Sorted text is stored in less, so a larger lookup can be broadcast.
    stored = durable(lookup.unionByName(bare).sortWithinPartitions("scope", "key"))
    scopes = sorted(r["scope"] for r in stored.select("scope").distinct().collect())
    span = queries.agg(F.min("date_lower"), F.max("date_upper")).first()
    phrases = F.col("scope").isin([s for s in scopes if _is_shape(s)])
    maps = [_bitmap(stored.where(~phrases)), _bitmap(stored.where(phrases))]
    return CompiledQueries(stored, rules, scopes, words, vocabulary, *maps, *span)


def _analysed(clauses: DataFrame) -> DataFrame:
    """Clauses as the analyser leaves articles: a stored pattern may be any text.

    Terms become one row a word, phrases lose stop words at their ends, patterns are written in
    lower case. What has no word left is dropped, and with it a group of nothing else.
    """
    if "node" not in clauses.columns:
        clauses = clauses.withColumn("node", F.lit(0))
    lower = F.lower("pattern")
    # A place that is empty already stands for any one word.
    blank = F.array(F.lit(""))
    cut = F.transform(F.split("pattern", " "), lambda p: F.when(p == "", blank).otherwise(analyzed_positions(p)))
    places = F.trim(F.array_join(F.flatten(cut), " "))
    term = F.struct(F.lit("term").alias("kind"), F.lit(0).alias("distance"))
    own = F.struct("kind", "distance")
    with_pattern = lambda head, text: F.array(F.struct(text.alias("pattern"), head.alias("as")))
    bare = (F.col("kind") == "wildcard") & ~F.rlike(lower, F.lit("[*?]"))
    exact = (F.col("kind") == "fuzzy") & (F.col("distance") <= 0)
    words = F.transform(
        F.array_distinct(analyzed_positions(F.col("pattern"))),
        lambda w: F.struct(w.alias("pattern"), term.alias("as")),
    )
    made = (
        F.when(F.col("kind") == "term", words)
        .when((F.col("kind") == "phrase") & ~F.contains(places, F.lit(" ")), with_pattern(term, places))
        .when(F.col("kind") == "phrase", with_pattern(own, places))
        .when(bare | exact, with_pattern(term, lower))
        .otherwise(with_pattern(own, lower))
    )
    kept = ["query_id", "node", "alt", "grp", "neg", "field"]
    rows = clauses.where(F.col("pattern").isNotNull()).select(*kept, F.inline(made))
    return rows.where(F.col("pattern") != "").select(*kept, "pattern", "as.kind", "as.distance").distinct()


def _numbered(clauses: DataFrame) -> DataFrame:
    """Clauses with the scope of their key and the slot of their group in its query."""
    group = Window.partitionBy("query_id").orderBy("node", "alt", "neg", "grp")
    shape = F.array_join(
        F.transform(F.split("pattern", " "), lambda w: F.when(w == "", "0").otherwise("1")), ""
    )
    scope = F.concat_ws("/", "field", F.when(F.col("kind") == "phrase", shape).otherwise(F.lit(_WORD)))
    return clauses.withColumn("slot", F.dense_rank().over(group) - 1).withColumn("scope", scope)


def _bit(slot: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % _BITS).cast("int"))


def _masks(words: int, test: Column) -> Column:
    """The slots of the rows that pass, as one number for each mask word."""
    here = [test & (F.floor(F.col("slot") / _BITS) == w) for w in range(words)]
    none = F.lit(0).cast("bigint")
    return F.array(*[F.bit_or(F.when(h, _bit(F.col("slot"))).otherwise(none)) for h in here])


def _rules(clauses: DataFrame, words: int) -> DataFrame:
    """The program of each query: its nodes, innermost first, and the slots that each one sets."""
    alts = clauses.groupBy("query_id", "node", "alt").agg(
        _masks(words, ~F.col("neg")).alias("need"), _masks(words, F.col("neg")).alias("never")
    )
    nodes = alts.groupBy("query_id", "node").agg(F.collect_list(F.struct("need", "never")).alias("alts"))
    sets = (
        clauses.where(F.col("kind") == "node")
        .groupBy("query_id", F.col("pattern").cast("int").alias("node"))
        .agg(_masks(words, F.lit(True)).alias("sets"))
    )
    none = F.array(*[F.lit(0).cast("bigint")] * words)
    step = F.struct((-F.col("node")).alias("order"), "alts", F.coalesce("sets", none).alias("sets"))
    return nodes.join(sets, ["query_id", "node"], "left").groupBy("query_id").agg(
        F.sort_array(F.collect_list(step)).alias("steps")
    )


def _holds(hits: Column, words: int) -> Column:
    """Whether the query's program ends true on these hits (an array of mask words)."""
    at = lambda masks, w: F.get(masks, F.lit(w))

    def node(bits: Column, step: Column) -> Column:
        def alternative(alt: Column) -> Column:
            test = F.lit(True)
            for w in range(words):
                hit, need, never = at(bits, w), at(alt["need"], w), at(alt["never"], w)
                test = test & (hit.bitwiseAND(need) == need) & (hit.bitwiseAND(never) == 0)
            return test

        return F.exists(step["alts"], alternative)

    def run(bits: Column, step: Column) -> Column:
        added = F.array(*[at(bits, w).bitwiseOR(at(step["sets"], w)) for w in range(words)])
        return F.when(node(bits, step), added).otherwise(bits)

    last = F.element_at("steps", -1)  # node 0
    inner = F.slice("steps", F.lit(1), F.size("steps") - 1)
    return F.aggregate(inner, hits, run, lambda bits: node(bits, last))


def _place(scope: Column, key: Column) -> Column:
    """Where a word stands in the bitmap."""
    return F.pmod(F.xxhash64(scope, key), F.lit(_MAP_BITS))


def _bitmap(lookup: DataFrame) -> Column:
    """The words of the lookup, or the first words of its phrases, as a map of _MAP_BITS bits."""
    first = F.substring_index("key", " ", 1)
    places = lookup.select(_place(F.col("scope"), first).alias("at")).distinct().collect()
    found = [0] * (_MAP_BITS // 64)
    for (at,) in places:  # at most _MAP_BITS
        found[at // 64] |= 1 << at % 64
    signed = [n - (1 << 64) if n >> 63 else n for n in found]
    return F.from_json(F.lit(str(signed)), "array<bigint>")  # a constant: folded before it runs


def _used(scope: Column, word: Column, compiled: CompiledQueries) -> Column:
    """False for most words that no query needs in this scope, true for all others."""
    at = _place(scope, word)
    cell = F.shiftright(at, 6).cast("int")
    phrases = scope.isin([s for s in compiled.scopes if _is_shape(s)])
    held = F.when(phrases, F.get(compiled.starts, cell)).otherwise(F.get(compiled.used, cell))
    return F.call_function("shiftright", held, F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _sequence(words: Column, at: Column, shape: str) -> Column:
    """The words from a place on, as long as a phrase; the places of its stop words are left empty."""
    if "0" not in shape:
        return F.array_join(F.slice(words, at + 1, F.lit(len(shape))), " ")
    places = [F.get(words, at + j) if mark == "1" else F.lit("") for j, mark in enumerate(shape)]
    return F.concat_ws(" ", *places)


def _words(articles: DataFrame, name: str) -> Column:
    """Stored words where the corpus has them, else the words with the stop words among them.

    Few texts have an underscore, so few need the test of every word.
    """
    if STORED_WORDS[name] in articles.columns:
        return F.col(STORED_WORDS[name])
    text = joined(*SEARCH_TEXT[name])
    pieces = analyzed_pieces(text)
    return F.when(F.contains(text, F.lit("_")), F.filter(pieces, is_word)).otherwise(pieces)


def article_keys(articles: DataFrame, compiled: CompiledQueries) -> DataFrame:
    """Every key an article offers, for the scopes in use, next to its filter columns.

    The tests on a word come after the explode, where they stay in generated code. A phrase is
    put together only where its first word is in use.
    """
    fields = sorted({s.split("/")[0] for s in compiled.scopes} - {"doc"})
    kept = [ID, DATE, SUBJECT, SPATIAL]
    worded = articles.select(*kept, *[_words(articles, f).alias(STORED_WORDS[f]) for f in fields])
    offers = F.array(*[F.struct(F.lit(s).alias("scope"), _offered(s).alias("words")) for s in compiled.scopes])
    placed = worded.select(*kept, F.inline(offers)).select(*kept, "scope", "words", F.posexplode("words").alias("at", "w"))
    word, scope = F.col("w"), F.col("scope")
    single = [s for s in compiled.scopes if s.partition("/")[2] == _WORD]
    plain = ~scope.isin(*single) | ((word != "") & ~is_stop_word(word))
    found = placed.where(_used(scope, word, compiled) & plain)
    key, whole = word, F.lit(True)
    for s in compiled.scopes:
        shape = s.partition("/")[2]
        if _is_shape(s):
            here = scope == s
            key = F.when(here, _sequence(F.col("words"), F.col("at"), shape)).otherwise(key)
            whole = whole & (~here | (F.col("at") + len(shape) <= F.size("words")))
    return found.where(whole).select(*kept, "scope", key.alias("key"))


def _is_shape(scope: str) -> bool:
    """Whether the keys of a scope are phrases."""
    shape = scope.partition("/")[2]
    return len(shape) > 1 and not set(shape) - {"0", "1"}


def _offered(scope: str) -> Column:
    """What an article offers in a scope: words, for phrases all of them in their order."""
    name, _, shape = scope.partition("/")
    once, none = F.array(F.lit("")), F.array().cast("array<string>")
    if scope == "doc":
        return once
    words = F.col(STORED_WORDS[name])
    if shape == _SOME:
        return F.when(F.exists(words, lambda w: (w != "") & ~is_stop_word(w)), once).otherwise(none)
    if shape == _LENGTH:
        sizes = F.array_distinct(F.transform(words, lambda w: F.when(is_stop_word(w), 0).otherwise(F.length(w))))
        return F.transform(F.array_remove(sizes, 0), lambda n: n.cast("string"))
    return words if _is_shape(scope) else F.array_distinct(words)


def _is_small(stored: DataFrame) -> bool:
    """Whether a stored table is below the broadcast threshold."""
    size = int(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size <= stored.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def held_keys(compiled: CompiledQueries) -> tuple[DataFrame, list[str]]:
    """Stored ``(scope, key)`` that are broadcast from a large lookup, and the scopes held as a whole.

    Scopes with few rows are held whole. Of the others those of words hold the words that are most
    frequent in the articles, with no regard to whether a query has them: a word that no query has
    then needs no shuffle either. These keys and their rows of the lookup are at most _HELD.
    """
    on, lookup = ["scope", "key"], compiled.lookup
    whole, room = [], _HELD // 2
    sizes = {r["scope"]: r["count"] for r in lookup.groupBy("scope").count().collect()}
    for scope in sorted(sizes, key=lambda s: (sizes[s], s)):
        if sizes[scope] <= room:
            whole.append(scope)
            room -= sizes[scope]
    held = lookup.where(F.col("scope").isin(whole)).select(*on).distinct()
    words = sorted(s for s in sizes if s not in whole and s.partition("/")[2] == _WORD)
    if words:
        uses = lookup.where(F.col("scope").isin(words)).groupBy(*on).agg(F.count(F.lit(1)).alias("uses"))
        offered = compiled.vocabulary.select(
            F.explode(F.array(*map(F.lit, words))).alias("scope"),
            F.col("term").alias("key"),
            F.floor(F.log2("n") * 8).alias("band"),
        )
        cost = F.col("cost")  # a word of very many queries is left to the split of heavy words
        costs = durable(
            offered.join(uses, on, "left")
            .select(*on, "band", (F.coalesce("uses", F.lit(0)) + 1).alias("cost"))
            .where(cost <= max(_HELD // 100, 2))
        )
        least, room = None, _HELD // 2
        bands = costs.groupBy("band").agg(F.sum(cost).alias("cost")).collect()  # at most 8 x 63
        for band, total in sorted(bands, reverse=True):
            if total > room:
                break
            least, room = band, room - total
        if least is not None:
            held = held.unionByName(costs.where(F.col("band") >= least).select(*on))
    return durable(held), whole


def meet_all(keys: DataFrame, compiled: CompiledQueries) -> DataFrame:
    """Article keys joined to the lookup of the queries, whatever its size.

    Beyond the broadcast threshold the keys in ``held_keys`` meet it by broadcast, so that the hits of
    an article are combined where they arise, and only keys of rare words are stored and shuffled.
    The articles are then cut into words twice.
    """
    on, lookup = ["scope", "key"], compiled.lookup
    if _is_small(lookup):
        return keys.join(lookup, on)
    held, whole = held_keys(compiled)
    held = F.broadcast(held)
    often = keys.join(F.broadcast(durable(lookup.join(held, on, "left_semi"))), on)
    if set(compiled.scopes) <= set(whole):
        return often
    rare = keys.where(~F.col("scope").isin(whole)).join(held, on, "left_anti")
    return often.unionByName(meet_lookup(rare, durable(lookup.join(held, on, "left_anti"))))


def meet_lookup(keys: DataFrame, lookup: DataFrame) -> DataFrame:
    """Article keys joined to the stored lookup on ``(scope, key)``.

    A lookup below the broadcast threshold is broadcast. Beyond it both sides are shuffled; then
    the keys are stored and counted first, and a word that stands in very many articles, or
    in very many queries, is split into parts on both sides.
    """
    on = ["scope", "key"]
    if _is_small(lookup):
        return keys.join(lookup, on)
    keys = durable(keys)
    left, right = _parts_of(keys, "left_parts"), _parts_of(lookup, "right_parts")
    split = durable(left.join(right, "place", "full"))

    def dealt(rows: DataFrame, own: str, other: str, row_id: str) -> DataFrame:
        """Rows with a part of their own side, and a copy for each part of the other side."""
        parts = lambda name: F.coalesce(f"{name}_parts", F.lit(1))
        return rows.join(F.broadcast(split), F.xxhash64(*on) == F.col("place"), "left").select(
            *rows.columns,
            F.pmod(F.xxhash64(row_id), parts(own)).cast("int").alias(f"{own}_part"),
            F.explode(F.sequence(F.lit(0), parts(other) - 1)).alias(f"{other}_part"),
        )

    halves = dealt(keys, "left", "right", ID), dealt(lookup, "right", "left", "query_id")
    return halves[0].join(halves[1], [*on, "left_part", "right_part"]).drop("left_part", "right_part")


def _parts_of(rows: DataFrame, name: str) -> DataFrame:
    """Into how many parts each hot key is split, by the hash of the key.

    At most _MOST_SPLIT keys can be hot, and a row has two numbers, so the table can be broadcast.
    """
    pieces = min(_FINE * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), _MOST_SPLIT)
    share = max(rows.count() // pieces, 1)
    counted = rows.groupBy(F.xxhash64("scope", "key").alias("place")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > share).select("place", F.ceil(F.col("n") / share).cast("int").alias(name))


def saved_query_matches(articles: DataFrame, compiled: CompiledQueries) -> DataFrame:
    """``(query_id, identifier)`` for every match of every query."""
    if not compiled.scopes:
        return articles.where(F.lit(False)).select(F.lit(0).alias("query_id"), ID)
    articles = articles.where(date_between(compiled.date_lower, compiled.date_upper))
    keys = article_keys(articles, compiled)
    filters = compiled.rules.drop("steps")
    hits = meet_all(keys, compiled).join(filters, "query_id").where(
        F.col(DATE).between(F.col("date_lower"), F.col("date_upper"))
        & ~F.coalesce(F.array_contains("article_types", F.col(SUBJECT)), F.lit(False))
        & ~F.coalesce(F.array_contains("distributions", F.col(SPATIAL)), F.lit(False))
    )
    bits = [
        F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("bigint"))).alias(f"hit{w}")
        for w in range(compiled.words)
    ]
    masks = hits.groupBy("query_id", ID).agg(*bits)
    hit = F.array(*[F.col(f"hit{w}") for w in range(compiled.words)])
    programs = compiled.rules.select("query_id", "steps")
    return masks.join(programs, "query_id").where(_holds(hit, compiled.words)).select("query_id", ID)


def query_counts(queries: DataFrame, matches: DataFrame) -> DataFrame:
    """``(query_id, count)``, with 0 for a query without a match."""
    counts = matches.groupBy("query_id").agg(F.count(F.lit(1)).alias("count"))
    ids = queries.select(F.col("id").alias("query_id"))
    return ids.join(counts, "query_id", "left").select(
        "query_id", F.coalesce("count", F.lit(0).cast("bigint")).alias("count")
    )


def _of_article(matches: DataFrame) -> DataFrame:
    return matches.groupBy(ID).agg(F.sort_array(F.collect_set("query_id")).alias("query_ids"))


def query_clouds(
    articles: DataFrame,
    matches: DataFrame,
    k: int | None = 100,
    min_length: int = 2,
    terms: DataFrame | None = None,
    tokeniser: str = "analyzed",
) -> DataFrame:
    """Top ``k`` words of title and content for each query: ``(query_id, term, count, rank)``.

    ``tokeniser`` is ``analyzed`` or ``stripped``; ``k`` None keeps all words. An article is cut
    into words once, however many queries it matches; with stored term frequencies in ``terms``
    it is not cut at all. Articles that match the same queries are counted together before
    their words are copied to each of them.
    """
    word = F.col("term")
    if terms is not None:
        rows = terms.where(F.col("field").isin(*CLOUD_FIELDS)).join(_of_article(matches), ID)
    else:
        matched = articles.select(ID, *CLOUD_FIELDS).join(_of_article(matches), ID)
        cut = {"analyzed": analyzed_pieces, "stripped": stripped_pieces}[tokeniser]
        pieces = F.explode(cut(joined(*CLOUD_FIELDS)))
        rows = matched.select("query_ids", pieces.alias("term"), F.lit(1).cast("bigint").alias("tf"))
        if tokeniser == "analyzed":
            rows = rows.where(is_word(word) & ~is_stop_word(word))
    kept = rows.where(F.length(word) >= min_length)
    together = kept.groupBy("query_ids", "term").agg(F.sum("tf").alias("tf"))
    per_query = together.select("term", "tf", F.explode("query_ids").alias("query_id"))
    counts = per_query.groupBy("query_id", "term").agg(F.sum("tf").alias("count"))
    best = Window.partitionBy("query_id").orderBy(F.desc("count"), "term")
    ranked = counts.withColumn("rank", F.row_number().over(best).cast("bigint"))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def query_stats(articles: DataFrame, queries: DataFrame, matches: DataFrame) -> DataFrame:
    """``query_id, words, docs`` for every query: the stripped words of its articles, and how many."""
    sized = articles.select(ID, token_count().alias("words")).join(_of_article(matches), ID)
    together = sized.groupBy("query_ids").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("docs"))
    found = together.select("words", "docs", F.explode("query_ids").alias("query_id"))
    totals = found.groupBy("query_id").agg(F.sum("words").alias("words"), F.sum("docs").alias("docs"))
    none = F.lit(0).cast("bigint")
    return queries.select(F.col("id").alias("query_id")).join(totals, "query_id", "left").select(
        "query_id", F.coalesce("words", none).alias("words"), F.coalesce("docs", none).alias("docs")
    )


def corpus_vocabulary(articles: DataFrame) -> DataFrame:
    """``term, n``: the analysed words of the searchable fields, and how often each one stands there."""
    if STORED_WORDS[ALL] in articles.columns:
        words = articles.select(F.explode(STORED_WORDS[ALL]).alias("term")).where(F.col("term") != "")
    else:
        words = articles.select(F.explode(analyzed_pieces(joined(*SEARCH_FIELDS))).alias("term"))
        words = words.where(is_word(F.col("term")) & ~is_stop_word(F.col("term")))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class BatchResult:
    matches: DataFrame  # query_id, identifier
    counts: DataFrame  # query_id, count, status
    clouds: DataFrame  # query_id, term, count, rank; with a gate, of the queries inside it
    articles: DataFrame  # those that any query can match by date


def run_batch(
    articles: DataFrame,
    queries: DataFrame,
    clauses: DataFrame,
    smallest: int | None = 10_000,
    largest: int | None = 50_000,
    k: int | None = 100,
    terms: DataFrame | None = None,
    tokeniser: str = "analyzed",
) -> BatchResult:
    """Match, count, gate and draw a word cloud for every saved query.

    Without bounds there is no gate. The span of all date ranges holds for every pass over the
    articles. Stored term frequencies (``terms``) of the corpus save the pass of the clouds.
    """
    span = queries.agg(F.min("date_lower"), F.max("date_upper")).first()
    articles = articles.where(date_between(*span))
    compiled = compile_queries(queries, clauses, corpus_vocabulary(articles))
    matches = durable(saved_query_matches(articles, compiled))
    counts = query_counts(queries, matches)
    if smallest is None and largest is None:
        counts = size_gate(counts, 0, 1 << 62)
        passed = matches
    else:
        counts = size_gate(counts, smallest or 0, 1 << 62 if largest is None else largest)
        passed = matches.join(counts.where(F.col("status") == "ok"), "query_id", "left_semi")
    clouds = query_clouds(articles, passed, k, terms=terms, tokeniser=tokeniser)
    return BatchResult(matches, counts, clouds, articles)
