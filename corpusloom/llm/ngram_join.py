"""N-gram Jaccard join: a size-aware heavy-light join, in DataFrame operations only.

Texts become sets of word 3-gram hashes; equal sets are one class with a representative, so copies cost
one row however many there are. Sets aren't stored, as they are larger than their texts: each step works
them out from the texts again. All sets are sorted by one global order: rare shingles first, judged by
their length at first, with those whose inverted lists turn out heavy moved to the end (a fixed-size bit
map of hash buckets tells them, so the order stays one function of the shingle). Then

* small sets, up to a boundary size, enumerate the 2-subsets of their first ``size - need + 2`` shingles:
  two small sets that link share one of these,
* the inverted lists of the first ``size - need + 1`` shingles are scanned for pairs with at least one
  large set,

where ``need`` is the least overlap that a set's links can have. Both kinds of lists are counted for all
sets first; the boundary is the one at which fewest pairs meet, by these counts.

A list of many sets is split into shares, and pairs meet in cells of two shares, so that no list, however
long, is one task's. A pair is met at its first common shingle: in a long list, sets that come from the same
list just before it met there, and the largest such group meets the others only. A pair passes size and
positional filters and is verified on the whole sets, which travel once to each cell that asks for them. In
a cell of many sets these are held against the shingles that most of them have, as two sets differ by as
much as their differences from a third do, and for near copies those are short. Components come from
alternating large-star and small-star steps until nothing changes.

Shingles are told apart by 57 bits of hash beside 6 bits of their length, equal sets by 96 bits and size.

Defined results: a text of one or two words has its word sequence as its only shingle; null, empty and
blank texts have none, no links and their own doc_id as component; every row is a document of its own,
repeated rows link with each other; a component without any doc_id has a null id; an empty table gives
an empty table; columns other than the id and the text are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_lower, discard, here, join_counted, let, numbered, quoted, table, words, written

N, NUM, DEN = 3, 70, 100
#: Lists that are longer than the least power of two from HEAVY on that no more than 1 / MAP_SPARE as many
#: lists pass as the map of heavy shingles has bits are heavy: their shingles go to the end of the order.
HEAVY, MAP_BITS, MAP_SPARE = 4, 22, 8
#: Boundaries between small and large that are weighed.
BOUNDARIES = (2, 4, 8, 16, 32)
#: Shared tokens before an entry that it carries.
PAST = 4
#: Sets, and shingles of sets, of a share of a list, about. A cell holds two shares.
CELL, CELL_SHINGLES = 64, 1 << 20
#: Sets of a cell from which on they are compared by their differences from what most of the first DENSE have.
DENSE = 16
#: Entries of a heavy list that one task counts, about.
COUNTED = 100_000
#: Row numbers that are broadcast at most; more are joined by a shuffle.
FEW_ROWS = 500_000
_HASH = (1 << 57) - 1
_NONE = "CAST(array() AS array<bigint>)"


def with_shingles(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep..., size, tokens): the sorted distinct shingles of ``text`` as longs; longer, so likely rarer, ones first.

    One step a column, as Spark compiles what stands at a step's top level, and only interprets what is in a lambda.
    """
    six = F.lit(63).cast("long")
    size = lambda x: x.bitwiseAND(six)
    both = lambda a, b: F.xxhash64(a, b).bitwiseAND(F.lit(~63)).bitwiseOR(F.least(six, size(a) + size(b)))
    code = lambda a, b: F.shiftleft(six - F.least(six, size(a) + size(b)), 57).bitwiseOR(F.xxhash64(a, b).bitwiseAND(F.lit(_HASH)))
    split = rows.select(*keep, words(ascii_lower(F.col("text"))).alias("w"))
    # a word's hash with its length in the low bits
    hashed = split.select(*keep, F.size("w").alias("n"), F.when(F.size("w") < N, F.array_join("w", " ")).alias("short"), F.transform("w", lambda x: F.shiftleft(F.xxhash64(x), 6).bitwiseOR(F.least(F.lit(63), F.octet_length(x)).cast("long"))).alias("c"))
    part = lambda c, start, short: F.slice(c, F.lit(start), F.greatest(F.lit(0), F.size(c) - short))
    twos = hashed.select(*keep, "n", "short", "c", F.zip_with(part("c", 1, 1), part("c", 2, 1), both).alias("d"))
    threes = twos.select(*keep, "n", "short", F.zip_with(part("d", 1, 1), part("c", 3, 2), code).alias("s"))
    whole = F.array(F.shiftleft(six - F.least(six, F.length("short").cast("long")), 57).bitwiseOR(F.xxhash64("short", F.lit("whole")).bitwiseAND(F.lit(_HASH))))
    tokens = F.when(F.col("n") >= N, F.sort_array(F.array_distinct("s"))).when(F.col("n") > 0, whole).otherwise(F.expr(_NONE))
    return threes.select(*keep, here(tokens).alias("tokens")).select(*keep, F.size("tokens").alias("size"), "tokens")


def _need(size: Column) -> Column:
    """Least overlap of a set of this size with any set that it links with."""
    return F.ceil(size * F.lit(NUM) / F.lit(DEN) - 1e-9).cast("int")


def _ahead(size: Column) -> Column:
    """Shingles of a set's own lists."""
    return size - _need(size) + 1


def _can_link(size: Column) -> Column:
    """Whether a set of this size can link with a different one at all."""
    return DEN * size >= NUM * (size + 1)


def _sizes_fit(a: Column, b: Column) -> Column:
    return DEN * F.least(a, b) >= NUM * F.greatest(a, b)


def _least_overlap(a: Column, b: Column) -> Column:
    return F.ceil((a + b) * F.lit(NUM) / F.lit(NUM + DEN) - 1e-9)


def _bucket(token: Column) -> Column:
    return token.bitwiseAND(F.lit((1 << MAP_BITS) - 1))


def heavy_length(lists: DataFrame) -> int:
    """The length beyond which a list is heavy."""
    bits = F.when(F.col("n") > HEAVY, F.ceil(F.log2(F.col("n").cast("double")))).otherwise(0).cast("int")
    longer = {r["b"]: r["count"] for r in lists.groupBy(bits.alias("b")).count().collect()}  # 64 rows at most
    length = HEAVY
    while sum(n for b, n in longer.items() if 2**b > length) > (1 << MAP_BITS) // MAP_SPARE:
        length *= 2
    return length


def heavy_map(heavy: DataFrame) -> list[int] | None:
    """The bit map of the heavy lists' shingles (token) as longs; None if there is none."""
    bits = heavy.select(_bucket(F.col("token")).alias("b"))
    word = bits.groupBy(F.shiftright("b", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b & 63 AS INT))")).alias("bits"))
    got = {r["word"]: r["bits"] for r in word.collect()}  # 2**MAP_BITS / 64 rows at most
    return [got.get(i, 0) for i in range(1 << (MAP_BITS - 6))] if got else None


def reordered(tokens: Column, length: Column, bits: Column | None) -> Column:
    """The first ``length`` tokens of a sorted array in the final order."""
    head = F.slice(tokens, F.lit(1), length)
    if bits is None:
        return head

    def heavy(x: Column) -> Column:
        b = _bucket(x)
        return F.getbit(F.get(bits, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1

    moved = F.concat(F.filter(tokens, lambda x: ~heavy(x)), F.filter(tokens, heavy))
    return let(head, lambda h: F.when(F.exists(h, heavy), F.slice(moved, F.lit(1), length)).otherwise(h))


def entries(sets: DataFrame, bits: Column | None) -> DataFrame:
    """(token, uid, size, pos, subset): list entries, and the 2-subsets of sets that are small at any boundary."""
    size, most = F.col("size"), max(BOUNDARIES)
    first = sets.select("uid", "size", reordered(F.col("tokens"), _ahead(size) + F.when(size <= most, 1).otherwise(0), bits).alias("h"))
    first = first.withColumn("h", here(F.col("h")))
    last = F.size("h") - 1
    two = F.flatten(F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.transform(F.sequence(i + 1, last), lambda j: F.xxhash64(F.get("h", i), F.get("h", j)))))
    full = first.select("uid", "size", F.concat(F.slice("h", F.lit(1), _ahead(size)), F.when(size <= most, two).otherwise(F.expr(_NONE))).alias("h")).withColumn("h", here(F.col("h")))
    each = full.select("uid", "size", F.posexplode("h").alias("at", "token"))
    subset = F.col("at") >= _ahead(size)
    return each.select("token", "uid", "size", F.when(subset, 0).otherwise(F.col("at")).alias("pos"), subset.alias("subset"))


def shared_entries(made: DataFrame, heavy: DataFrame) -> DataFrame:
    """Entries whose list has others: with its length n and the sizes' sum w.

    ``heavy`` (token, n, w): lists whose bounds are known from the first count. They are counted in parts.
    """
    known = heavy.select("token", F.lit(False).alias("subset"), F.col("n").alias("hn"), F.col("w").alias("hw"))
    salted = made.join(F.broadcast(known), ["token", "subset"], "left")  # MAP_BITS and MAP_SPARE bound the heavy lists
    salted = salted.withColumn("salt", F.when(F.col("hn") > COUNTED, F.pmod(F.xxhash64("uid"), F.ceil(F.col("hn") / COUNTED))).otherwise(0))
    over = Window.partitionBy("token", "subset", "salt")
    counted = salted.withColumns({"n": F.coalesce("hn", F.count("*").over(over)), "w": F.coalesce("hw", F.sum("size").over(over))})
    return counted.where("n > 1").drop("hn", "hw", "salt")


def choose_boundary(shared: DataFrame) -> tuple[int, dict[int, int]]:
    """The boundary at which fewest pairs meet, and the pairs at each.

    A list's pairs count where one set at least is large, a 2-subset's where both are small.
    """
    size = F.col("size")
    by = shared.groupBy("token", "subset").agg(F.count("*").cast("double").alias("m"), *(F.count_if(size <= b).cast("double").alias(f"s_{b}") for b in BOUNDARIES))
    pairs = lambda x: x * (x - 1) / 2
    cost = {b: F.when(F.col("subset"), pairs(F.col(f"s_{b}"))).otherwise(pairs(F.col("m")) - pairs(F.col(f"s_{b}"))) for b in BOUNDARIES}
    got = by.agg(*(F.coalesce(F.sum(v), F.lit(0.0)).alias(str(b)) for b, v in cost.items())).collect()[0]
    return min(BOUNDARIES, key=lambda b: (got[str(b)], b)), {b: int(got[str(b)]) for b in BOUNDARIES}


def main_groups(used: DataFrame) -> DataFrame:
    """(token, subset, main, m, r) of the long lists: most of their entries, m of them, come from list ``main`` just before, r don't."""
    groups = used.where(F.col("n") > CELL).groupBy("token", "subset", F.get("past", F.lit(0)).alias("main")).agg(F.count("*").alias("m"))
    lists = groups.groupBy("token", "subset").agg(F.sum("m").alias("all"), F.max(F.when(F.col("main").isNotNull(), F.struct("m", "main"))).alias("x"))
    return lists.where("x IS NOT NULL").select("token", "subset", "x.main", "x.m", (F.col("all") - F.col("x.m")).alias("r"))


def in_cells(used: DataFrame, main: DataFrame) -> DataFrame:
    """Entries in the cells (lo, hi), each of two shares, of their list: one row a cell.

    The entries of a list's main group all meet in the list that they come from, so they have shares of
    their own here, and no cell for two of these.
    """
    shares = lambda n: F.greatest(F.ceil(n / CELL), F.least(n, F.ceil(F.col("w") / CELL_SHINGLES))).cast("int")
    split = used.join(main, ["token", "subset"], "left").withColumn("in_main", F.coalesce(F.get("past", F.lit(0)) == F.col("main"), F.lit(False)))
    split = split.withColumns({"k": shares(F.coalesce("r", "n")), "km": shares(F.coalesce("m", F.lit(0)))}).where("k > 0")
    split = split.withColumn("share", F.when(F.col("in_main"), F.col("k") + F.pmod(F.xxhash64("uid"), F.col("km"))).otherwise(F.pmod(F.xxhash64("uid"), F.col("k"))).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("in_main"), F.col("k")).otherwise(F.col("k") + F.col("km")) - 1)))
    return split.withColumns({"lo": F.least("share", "other"), "hi": F.greatest("share", "other")}).drop("main", "m", "r", "in_main", "k", "km", "other")


def candidate_pairs(shared: DataFrame, boundary: int) -> DataFrame:
    """(a, b, cell), a < b, a written table: once each pair of entries' sets that share a token and pass the filters.

    An entry carries the shared tokens just before it. Where two entries have one of these in common, the
    pair meets there already, so near copies, whose whole lists coincide, are paired about once. A pair's
    first common token has none before it in common, and there the filters hold for every link.
    """
    large = (F.col("size") > boundary) | (DEN * F.col("size") >= NUM * (boundary + 1))
    used = shared.where(F.when(F.col("subset"), F.col("size") <= boundary).otherwise(large))
    before = Window.partitionBy("uid", "subset").orderBy("pos", "token")
    past = F.array_compact(F.array(*(F.lag("token", i).over(before) for i in range(1, PAST + 1))))
    used = used.withColumn("past", past).withColumn("past", F.when(F.col("subset"), F.expr(_NONE)).otherwise(F.col("past")))
    main = written(main_groups(used), "jaccard-main")
    placed = in_cells(used, F.broadcast(main) if main.count() <= FEW_ROWS else main)
    cell = ["token", "subset", "lo", "hi"]
    a, b = (placed.select(*cell, *(F.col(c).alias(c + x) for c in ("uid", "size", "pos", "past", "share"))) for x in "ab")
    sa, sb = F.col("sizea"), F.col("sizeb")
    rest = 1 + F.least(sa - F.col("posa"), sb - F.col("posb")) - 1
    fit = F.col("subset") | (((sa > boundary) | (sb > boundary)) & (rest >= _least_overlap(sa, sb)) & ~F.arrays_overlap("pasta", "pastb"))
    here = (F.col("lo") == F.col("hi")) | (F.col("sharea") != F.col("shareb"))
    met = a.join(b, cell).where((F.col("uida") < F.col("uidb")) & here & _sizes_fit(sa, sb) & fit)
    out = written(met.groupBy(F.col("uida").alias("a"), F.col("uidb").alias("b")).agg(F.min(F.struct(*cell)).alias("cell")), "jaccard-candidates")
    discard(main)
    return out


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b, cell) that link, from ``texts`` (uid, text). A cell gets each of its sets once."""
    there = written(pairs.select("cell", F.explode(F.array("a", "b")).alias("uid")).distinct(), "jaccard-there")
    wanted = there.select("uid").distinct()
    few = there.count() <= FEW_ROWS
    hint = F.broadcast if few else (lambda x: x)
    own = with_shingles(texts.join(hint(wanted), "uid", "left_semi"), "uid")
    held = own.join(hint(there), "uid").groupBy("cell").agg(F.collect_list(F.struct("uid", "size", "tokens")).alias("s"))
    asked = pairs.groupBy("cell").agg(F.collect_list(F.struct("a", "b")).alias("p"))

    def most(s: Column) -> Column:
        """The tokens of more than half of the first sets of a dense cell."""
        first = F.slice(s, 1, DENSE)
        every = let(F.sort_array(F.flatten(F.transform(first, lambda x: x["tokens"]))), lambda e: F.filter(e, lambda x, i: x == F.get(e, i + DENSE // 2)))
        return F.when(F.size(s) >= DENSE, F.array_distinct(every)).otherwise(F.expr(_NONE))

    def apart(s: Column) -> Column:
        """The sets (uid, size, d): d has the tokens that only one of the set and ``most`` has."""
        differ = lambda x, r: F.when(F.size(r) > 0, F.concat(F.array_except(x, r), F.array_except(r, x))).otherwise(x)
        return let(most(s), lambda r: F.transform(s, lambda x: F.struct(x["uid"].alias("uid"), x["size"].cast("long").alias("size"), differ(x["tokens"], r).alias("d"))))

    def does(a: Column, b: Column) -> Column:
        both, da, db = a["size"] + b["size"], F.size(a["d"]), F.size(b["d"])
        # twice the overlap is the sizes' sum less those of d, and twice the overlap of d
        enough = lambda common: (NUM + DEN) * (both - da - db + 2 * common) >= 2 * NUM * both
        return F.when(enough(F.lit(0)), True).when(~enough(F.least(da, db)), False).otherwise(enough(F.size(F.array_intersect(a["d"], b["d"]))))

    def links(s: Column, p: Column) -> Column:
        def one(ids: Column, x: Column) -> Column:
            at = lambda uid: F.get(s, (F.array_position(ids, uid) - 1).cast("int"))
            return let(F.struct(at(x["a"]).alias("a"), at(x["b"]).alias("b")), lambda t: does(t["a"], t["b"]))

        return let(F.transform(s, lambda x: x["uid"]), lambda ids: F.filter(p, lambda x: one(ids, x)))

    held = held.withColumn("s", here(apart(F.col("s"))))
    out = written(asked.join(held, "cell").select(F.explode(links(F.col("s"), F.col("p"))).alias("x")).select("x.a", "x.b"), "jaccard-links")
    discard(there)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b), a written table; root is its component's least node."""
    edges = written(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "components")
    state = lambda: tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).collect()[0])
    now = state()
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "v"))
        # large star: larger neighbours of v meet v's least neighbour
        large = written(join_counted(both.where("u > v"), least, ["v"], "n", 2 * now[0]).select(F.col("u").alias("v"), F.col("m").alias("u")).distinct(), "components")
        # small star: v and its smaller neighbours meet the least of them
        least = large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
        met = join_counted(large, least, ["v"], "n", now[0])
        small = met.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u"))).where("v <> u").distinct()
        old, edges = edges, written(small, "components")
        discard(old, large)
        before, now = now, state()
        if now == before:
            break
    roots = edges.groupBy("v").agg(F.min("u").alias("root")).select(F.col("v").alias("node"), "root")
    out = written(roots.unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()), "jaccard-roots")
    discard(edges)
    return out


def jaccard_groups(docs: DataFrame, key: str = "doc_id", uid: str | None = None, boundary: int | None = None) -> DataFrame:
    """(key, n_shingles, n_similar, component_id) of every row.

    ``uid`` names a column of row numbers that any scan of docs repeats; rows are numbered here without one.
    ``boundary`` replaces the one chosen by cost.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(quoted(key)).alias("key"), F.col("text"), *([F.col(quoted(uid)).alias("uid")] if uid else []))
    rows = rows if uid else numbered(rows, "uid")
    print_ = ["f1", "f2", "size"]
    member = with_shingles(rows, "uid", "key").select("uid", "key", "size", F.xxhash64("tokens").alias("f1"), F.hash("tokens").alias("f2"))
    member = written(member, "jaccard-members")
    total, some = member.count(), member.where("size > 0")
    classes = written(some.groupBy(*print_).agg(F.min("uid").alias("rep"), F.count("*").alias("n"), F.min("key").alias("first")), "jaccard-classes")

    # a text a class: all without the copies if they are few, else with the first of each by a shuffle into a table
    reps, texts, held = classes.select(F.col("rep").alias("uid")), rows.select("uid", "text"), []
    if total - classes.count() <= FEW_ROWS:
        texts = texts.join(F.broadcast(member.select("uid").join(reps, "uid", "left_anti")), "uid", "left_anti")
    else:
        texts = written(texts.join(reps, "uid", "left_semi"), "jaccard-texts")
        held.append(texts)
    sets = with_shingles(texts, "uid")
    sets = sets.where(_can_link(F.col("size")))

    drawn = sets.select("size", F.explode(F.slice("tokens", F.lit(1), _ahead(F.col("size")))).alias("token"))
    lists = written(drawn.groupBy("token").agg(F.count("*").alias("n"), F.sum("size").alias("w")).where("n > 1"), "jaccard-lists")
    heavy = lists.where(F.col("n") > heavy_length(lists))
    map_ = heavy_map(heavy)
    bits = F.lit(None) if map_ is None else spark.createDataFrame([(map_,)], "bits array<long>").scalar()
    made = entries(sets.withColumn("bits", bits), None if map_ is None else F.col("bits"))
    shared = written(shared_entries(made, heavy), "jaccard-entries")
    discard(lists)
    pairs = candidate_pairs(shared, choose_boundary(shared)[0] if boundary is None else boundary)
    discard(shared)
    links = verified(pairs, texts)
    discard(pairs, *held)

    size_of = classes.select("rep", "n", "first")
    ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ways.join(size_of.select(F.col("rep").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("linked")).withColumnRenamed("a", "rep")
    roots = components(links)
    root = roots.withColumnRenamed("node", "rep")
    named = root.join(size_of, "rep").groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("m"))
    component = join_counted(root, named, ["root"], "m", total).select("rep", "component")
    about = classes.join(others, "rep", "left").join(component, "rep", "left")
    about = written(about.select(*print_, "n", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("component", "first").alias("component")), "jaccard-about")
    discard(classes, links, roots)
    out = join_counted(some, about, print_, "n", total)
    full = out.select(F.col("key").alias(key), F.col("size").cast("long").alias("n_shingles"), (F.col("n") - 1 + F.col("linked")).cast("long").alias("n_similar"), F.col("component").alias("component_id"))
    none = member.where("size = 0").select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_shingles"), F.lit(0).cast("long").alias("n_similar"), F.col("key").alias("component_id"))
    return full.unionByName(none)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
    WHEN len(w) > 0 THEN ['=' || array_to_string(w, ' ')] ELSE [] END) AS s FROM d
), t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 70 * (a.n + b.n - count(*))
), reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(n, 0) AS n_similar, least(doc_id, coalesce(c, doc_id)) AS component_id
FROM s LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) l ON l.a = doc_id
  LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = doc_id
"""
