"""Problem 4: variant spellings of the names of persons and organisations.

A name is folded (look-alikes), split into tokens, and freed of what only some
spellings have: titles, quoted nicknames, middle initials, connecting words;
short forms of given names become long ones. Names with the same tokens in any
order are one node. Nodes are blocked by token suffixes (and, since a slip may
stand near a token's end, by suffixes of the reversed tokens); an overly common
suffix is refined with the beginnings and endings of the name's other tokens
before it is used. Pairs are compared token by token: equal, an abbreviation, or
alike by the ratio of their longest common subsequence. Links join up to
entities, and entities of persons and organisations list their spellings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.llm.lookalike import fold
from fernglass.plans.components import min_propagation
from fernglass.runtime import materialize

SHORTEST_SUFFIX = 4
BLOCK = 40  # nodes a suffix may have before it is refined
RATIO, RATIO_SHORT = 0.84, 0.8  # of tokens from 7 letters on, and of those of 5 or 6
ALONE = 7  # letters of a name of one token
TOKENS = 7  # names of more tokens only match in the order of their tokens
ABBREVIATED = 6  # letters up to which a token may abbreviate another by some of its letters
ALIASES = 100_000  # rows the table of short forms may have
PART = 400  # spellings of an entity in a part; the parts of a larger one are paired with the whole, each on its own

# Titles that may precede a name, and words that join a name's parts.
TITLES = {"mr", "mrs", "ms", "miss", "mx", "dr", "prof", "professor", "sir", "dame", "lord", "lady", "rev", "hon", "capt", "captain", "col", "gen", "lt", "sgt", "maj", "st", "saint", "madam", "judge", "justice", "president", "senator"}
JOINING = {"the", "of", "and", "for"}
_QUOTED = re.compile(r"[“\"„«(\[][^”\"“»)\]]*[”\"“»)\]]")
_PARTS = re.compile(r"[\s,;/]+")
_DOTTED = re.compile(r"\w(?:\.\w)+")  # initials of several words stand for these words,
_CAPITALS = re.compile(r"[A-Z]{2,4}")  # and so do a few capitals in a name of mixed case
_EDGE = re.compile(r"^[^\w&]+|[^\w&]+$")


def name_tokens(name: str, aliases: dict[str, str]) -> list[str]:
    """The tokens by which a name is compared, sorted; see the module's text."""
    return sorted(_in_order(fold(name), aliases))


def middle_name(name: str, aliases: dict[str, str]) -> str | None:
    """The token between the first and the last of a name of three, where a comma puts the last one first; after more words, a comma leaves the order open."""
    last, comma, first = _QUOTED.sub(" ", fold(name)).partition(",")
    if comma and len(last.split()) > 1:
        return None
    tokens = _in_order(f"{first} {last}", aliases)
    return tokens[1] if len(tokens) == 3 else None


def _in_order(text: str, aliases: dict[str, str]) -> list[str]:
    rest = _QUOTED.sub(" ", text)
    raw = [t for t in (_EDGE.sub("", p).replace("'", "").replace("’", "") for p in _PARTS.split(rest if len(rest.split()) > 1 else text)) if t]
    mixed = any(c.islower() for c in text)
    raw = [x for t in raw for x in (t.split(".") if _DOTTED.fullmatch(t) else list(t) if mixed and _CAPITALS.fullmatch(t) else ["and" if t == "&" else t])]
    kept = [t for t in raw if t.casefold() not in JOINING] or raw
    capital = any(t[0].isupper() for t in kept)
    while len(kept) > 2 and (kept[0].casefold() in TITLES or (capital and kept[0].islower() and len(kept[0]) > 2)):
        kept = kept[1:]
    long = [t for t in kept if len(t) > 1]
    if len(long) >= 2 and len(long) < len(kept):
        kept = long
    return [aliases.get(c, c) for c in (t.casefold() for t in kept)]


def common_subsequence(a: str, b: str) -> int:
    """The length of the longest common subsequence, a bit for every character of ``a``."""
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    whole = (1 << len(a)) - 1
    s = whole
    for c in b:
        u = s & place.get(c, 0)
        s = ((s + u) | (s - u)) & whole
    return len(a) - s.bit_count()


def subsequence(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


def token_match(a: str, b: str) -> int:
    """3 equal, 2 alike by common subsequence, 1 abbreviation, 0 neither."""
    if a == b:
        return 3
    if len(a) > len(b):
        a, b = b, a
    if len(a) >= 5 and 2 * common_subsequence(a, b) >= (RATIO if len(b) >= 7 else RATIO_SHORT) * (len(a) + len(b)):
        return 2
    if a[0] == b[0] and (len(a) == 1 or b.startswith(a) or (len(a) <= len(b) - 1 and len(a) <= ABBREVIATED and subsequence(a, b))):
        return 1
    return 0


def names_match(a: list[str], b: list[str]) -> bool:
    """Whether two names' tokens can be matched one to one.

    Equal tokens belong to each other. One matched pair of at least 5 letters
    must be equal or alike (in a name of two tokens, one of 3 if the other is equal
    or an abbreviation), and at most one (of more than two tokens, two) may be
    merely alike. Names of one token, of at least ``ALONE`` letters, must be alike.
    A name of two tokens also matches one that has both and one more; that this is a
    middle name, :func:`links` sees to.
    """
    k = len(a)
    if k > len(b):
        a, b, k = b, a, len(b)
    if len(b) == k + 1:
        return k == 2 and not Counter(a) - Counter(b) and max(map(len, a)) >= 5
    if k != len(b):
        return False
    if k == 1:
        return a == b or min(len(a[0]), len(b[0])) >= ALONE and token_match(a[0], b[0]) == 2
    if k == 2 and (shared := next((t for t in a if t in b), None)) is not None:
        # by far the most frequent case: one token in common, one against one
        x, y = a[a[0] == shared], b[b[0] == shared]
        got = token_match(x, y)
        return bool(got) and (len(shared) >= 5 or got == 3 or (min(len(x), len(y)) >= 5 if got == 2 else len(shared) >= 3))
    common = Counter(a) & Counter(b)
    rest_a, rest_b = sorted((Counter(a) - common).elements()), sorted((Counter(b) - common).elements())
    firm = any(len(t) >= 5 for t in common)
    level = [[token_match(x, y) for y in rest_b] for x in rest_a]
    if any(not any(row) for row in level):
        return False
    m = len(rest_a)
    for order in permutations(range(m)) if m <= TOKENS else [range(m)]:
        got = [level[i][j] for i, j in enumerate(order)]
        sure = firm or any(g == 2 and min(len(rest_a[i]), len(rest_b[j])) >= 5 for (i, j), g in zip(enumerate(order), got, strict=True))
        if 0 not in got and sure and got.count(2) <= 1 + (k > 2):
            return True
    return False


def spellings(triples: DataFrame, raw_triples: DataFrame) -> DataFrame:
    """(name, type, n): every distinct string of the four columns, with its type if any row has one, and its rows."""
    both = lambda df, *columns: df.select(F.explode(F.array(*columns)).alias("name")).where("name is not null and name <> ''")
    n = both(triples, "subject", "object").unionByName(both(raw_triples, "subject_text", "object_text")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    # few rows have a type, and the greatest string of a group is found by sorting, so these rows go by themselves
    of = lambda name, kind: triples.where(F.col(kind).isNotNull()).select(F.col(name).alias("name"), F.col(kind).alias("type"))
    typed = of("subject", "subject_type").unionByName(of("object", "object_type")).distinct().groupBy("name").agg(F.max("type").alias("type"))
    return n.join(typed, "name", "left").select("name", "type", "n")


def alias_map(name_aliases: DataFrame) -> dict[str, str]:
    """Short forms that stand for one long form, without case. The table is of a fixed size; more than ``ALIASES`` rows are refused."""
    rows = name_aliases.where("short_form is not null and long_form is not null").limit(ALIASES + 1).collect()
    if len(rows) > ALIASES:
        raise ValueError("name_aliases is too large to be held by every task")
    long: dict[str, set[str]] = {}
    for r in rows:
        long.setdefault(fold(r.short_form).casefold(), set()).add(fold(r.long_form).casefold())
    return {s: next(iter(v)) for s, v in long.items() if len(v) == 1}


def parsed(names: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """(name, type, n, look, node, middle): the name's folded form, its sorted tokens in one string, and of three tokens the middle one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            look = pa.array([fold(x) for x in names], pa.string())
            node = pa.array([" ".join(name_tokens(x, aliases)) for x in names], pa.string())
            middle = pa.array([middle_name(x, aliases) for x in names], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), look, node, middle], names=["name", "type", "n", "look", "node", "middle"])

    return names.select("name", "type", "n").mapInArrow(run, "name string, type string, n long, look string, node string, middle string")


def _ends(token, shortest: int):
    """The suffix of ``shortest`` characters of a token and of the token reversed; longer ones lie within these blocks."""
    return F.when(F.length(token) >= shortest, F.array(F.concat(F.lit("<"), F.right(token, F.lit(shortest))), F.concat(F.lit(">"), F.left(token, F.lit(shortest))))).otherwise(F.array().cast("array<string>"))


def _ends_of(others, alone, single):
    """[(j, r)]: the first 3 and last 4 letters of the j-th other token; for a name of one token, all of ``single`` under 0."""
    end = lambda j, r: F.named_struct(F.lit("j"), j, F.lit("r"), r)
    of = F.transform(others, lambda o, j: F.array_compact(F.array(end(j, F.concat(F.lit(">"), F.left(o, F.lit(3)))), F.when(F.length(o) > 4, end(j, F.concat(F.lit("<"), F.right(o, F.lit(4))))))))
    return F.when(alone, F.transform(single, lambda r: end(F.lit(0), r))).otherwise(F.flatten(of))


def blocks(nodes: DataFrame, shortest: int = SHORTEST_SUFFIX) -> DataFrame:
    """(node, key, first, second, third, others): suffix keys, the refinements of each by the other tokens, and these.

    A name without a token of ``shortest`` letters has its tokens of two letters or
    more as keys. A name of one token is refined by its own longer ends.
    """
    p = nodes.select("node", F.split("node", " ").alias("t")).select("node", "t", F.posexplode("t").alias("i", "token"))
    own = F.when(F.forall("t", lambda x: F.length(x) < shortest) & (F.length("token") > 1), F.array(F.concat(F.lit("="), "token"))).otherwise(_ends(F.col("token"), shortest))
    others = F.filter("t", lambda x, j: j != F.col("i"))
    alone = F.size("t") == 1

    def refined(left: int, right: int, from_length: int, end: int):
        by = F.array_distinct(F.concat(F.transform(others, lambda o: F.concat(F.lit(">"), F.left(o, F.lit(left)))), F.transform(F.filter(others, lambda o: F.length(o) > from_length), lambda o: F.concat(F.lit("<"), F.right(o, F.lit(right))))))
        return F.when(alone, F.array(F.concat(F.lit("1>"), F.left("token", F.lit(end))), F.concat(F.lit("1<"), F.right("token", F.lit(end))))).otherwise(by)

    # of two tokens at most one is merely alike: whoever matches has this one whole, or the other
    third = F.when(F.size("t").isin(2, 3), F.concat(F.array(F.concat(F.lit("t"), "token")), F.transform(others, lambda o: F.concat(F.lit("o"), o)))).otherwise(F.array(F.lit("1")))
    return p.select("node", F.explode(F.array_distinct(own)).alias("key"), refined(1, 3, 3, 5).alias("first"), _ends_of(others, alone, refined(3, 4, 4, 6)).alias("second"), third.alias("third"), others.alias("others"))


def _abbreviations(others, r):
    """Beginnings of those tokens that may abbreviate another, where their first letter is that of ``r``."""
    return F.array_distinct(F.transform(F.filter(others, lambda o: (F.length(o) <= ABBREVIATED) & (F.concat(F.lit(">"), F.left(o, F.lit(1))) == r)), lambda o: F.left(o, F.lit(3))))


def _abbreviated(others, r):
    """What the tokens with the first letter of ``r`` may be abbreviated to, as far as three letters."""

    def of(o):
        c = F.array_distinct(F.split(F.substring(o, 2, 1_000_000), ""))
        pairs = F.flatten(F.transform(F.sequence(F.lit(2), F.length(o)), lambda i: F.transform(F.array_distinct(F.split(F.substr(o, i + 1), "")), lambda x: F.concat(F.left(o, F.lit(1)), F.substr(o, i, F.lit(1)), x))))
        return F.concat(F.array(F.left(o, F.lit(1))), F.transform(c, lambda x: F.concat(F.left(o, F.lit(1)), x)), pairs)

    return F.array_distinct(F.flatten(F.transform(F.filter(others, lambda o: (F.length(o) > 1) & (F.concat(F.lit(">"), F.left(o, F.lit(1))) == r)), of)))


def _sized(rows: DataFrame) -> DataFrame:
    """``rows`` of keys that several have, with their number ``n``; keys are counted by an aggregation, so a hot one burdens no task."""
    n = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return materialize(rows.join(n, "key"))


def candidates(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b, without repeats: nodes that share a suffix, refined where it is common.

    In the second refinement, tokens meet by their beginnings and endings, and short
    ones also with every token that they may abbreviate. In blocks that stay large,
    names of two tokens must have one of them in common, and a longer one looks for
    others only by its least common token, as :func:`names_match` demands all. No
    suffix is discarded.
    """
    rows = _sized(blocks(nodes).select("node", F.xxhash64("key").alias("key"), "first", "second", "third", "others"))
    kept = [rows.where(F.col("n") <= block).select("node", "key")]
    wide = rows.where(F.col("n") > block).select("node", F.explode("first").alias("r"), "key", "second", "third", "others").select("node", F.xxhash64("key", "r").alias("key"), "second", "third", "others", "r")
    wide = _sized(wide)
    kept.append(wide.where(F.col("n") <= block).select("node", "key"))
    hot = wide.where(F.col("n") > block).drop("n")
    narrow = hot.select("node", "key", F.explode("second").alias("s"), "third").select("node", F.col("key").alias("within"), "s.j", F.xxhash64("key", "s.r").alias("key"), "third")
    n = narrow.select("node", "key").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    narrow = materialize(narrow.join(n, "key"))
    kept.append(narrow.where((F.col("n") > 1) & (F.col("n") <= block)).select("node", "key").distinct())
    large = narrow.where(F.col("n") > block)
    whole = large.select("node", F.size("third").alias("k"), F.explode("third").alias("r"), "key").select("node", "k", F.xxhash64("key", "r").alias("key")).distinct()
    kept.append(whole.where("k = 2").select("node", "key"))
    middle = whole.where("k = 2").select(F.col("node").alias("s"), "key").join(whole.where("k = 3").select(F.col("node").alias("f"), "key"), "key").select(F.least("s", "f").alias("a"), F.greatest("s", "f").alias("b"))
    # every token must be met, so of three or more the least common decides: only by its ends a node looks for others in large blocks
    size = narrow.groupBy("node", "within", "j").agg(F.max("n").alias("n")).groupBy("node", "within").agg(F.min_by("j", F.struct("n", "j")).alias("j"))
    large = large.where(F.size("third") != 2)
    probe = large.join(size, ["node", "within", "j"]).select(F.col("node").alias("s"), "key").distinct()
    sought = probe.join(large.select(F.col("node").alias("f"), "key").distinct(), "key").where("s <> f").select(F.least("s", "f").alias("a"), F.greatest("s", "f").alias("b"))
    begins = hot.where(F.col("r").startswith(">"))
    short, full = (begins.select("node", "key", F.explode(f(F.col("others"), F.col("r"))).alias("x")) for f in (_abbreviations, _abbreviated))
    met = short.withColumnRenamed("node", "s").join(full.withColumnRenamed("node", "f"), ["key", "x"]).where("s <> f").select(F.least("s", "f").alias("a"), F.greatest("s", "f").alias("b"))
    # few rows, from each of which many pairs are made: over all cores, however few files they are read from
    cores = nodes.sparkSession.sparkContext.defaultParallelism
    every = reduce(DataFrame.unionByName, kept).repartition(max(cores, rows.rdd.getNumPartitions()), "key").withColumn("k", F.size(F.split("node", " ")))
    ka, kb = F.col("ka"), F.col("kb")
    same = every.select(F.col("node").alias("a"), "key", F.col("k").alias("ka")).join(every.select(F.col("node").alias("b"), "key", F.col("k").alias("kb")).hint("merge"), "key")
    same = same.where("a < b").where((ka == kb) | (F.abs(ka - kb) == 1) & (F.least(ka, kb) == 2)).select("a", "b")
    return same.unionByName(met).unionByName(middle).unionByName(sought).distinct()


def links(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose names match.

    Of a name of three tokens, what one of two lacks must be its middle in some
    spelling of ``names`` (node, middle), or a title: "the chamber orchestra" has two
    of the tokens of every organisation that ends so, and names none of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = x.split(" "), y.split(" ")
                if names_match(a, b):
                    few, many = (a, b) if len(a) < len(b) else (b, a)
                    more = next((Counter(many) - Counter(few)).elements(), None) if len(few) < len(many) else None
                    rows.append((x, y, " ".join(many), None if more in TITLES else more))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [()] * 4)], names=["a", "b", "node", "middle"])

    ka, kb = (F.size(F.split(c, " ")) for c in "ab")
    found = pairs.where((ka == kb) | (F.abs(ka - kb) == 1) & (F.least(ka, kb) == 2)).mapInArrow(run, "a string, b string, node string, middle string")
    # pairs that need no middle find none, and lie spread by their node
    known = names.where("middle is not null").select("node", F.col("middle").alias("extra")).distinct()
    kept = found.withColumn("extra", F.coalesce("middle", F.lit(""))).join(known.withColumn("known", F.lit(True)), ["node", "extra"], "left")
    return kept.where("middle is null or known").select("a", "b")


def entities(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, look, n, entity, type): linked names share an entity; its type is that of most of its rows, else, where a spelling has a capital, that of its tokens in typed names."""
    comp = materialize(min_propagation(edges, "a", "b"))
    x = names.join(comp.withColumnRenamed("id", "node"), "node", "left").withColumn("entity", F.coalesce("component", "node"))
    x = materialize(x.select("name", "look", "n", "type", "node", "entity"))
    most = lambda df, n: df.groupBy("entity").agg(F.max_by("type", F.struct(F.col(n), F.col("type"))).alias("type"))
    known = most(x.where("type is not null").groupBy("entity", "type").agg(F.sum("n").alias("n")), "n")
    tokens = x.select("entity", "type", F.explode(F.split("node", " ")).alias("token"))
    votes = tokens.where("type is not null").groupBy("token", "type").agg(F.count(F.lit(1)).alias("n"))
    # general phrases are never typed and never capital; the names of persons and organisations are in at least one spelling
    capital = x.groupBy("entity").agg(F.bool_or(F.lower("name") != F.col("name")).alias("c")).where("c").select("entity")
    bare = tokens.join(known, "entity", "left_anti").join(capital, "entity", "left_semi").select("entity", "token").distinct()
    guessed = most(bare.join(votes, "token").groupBy("entity", "type").agg(F.sum("n").alias("n")), "n")
    return x.drop("type").join(known.unionByName(guessed), "entity")


def variant_pairs(triples: DataFrame, raw_triples: DataFrame, name_aliases: DataFrame, expanded: int | None = None) -> DataFrame:
    """(name_a, name_b), name_a < name_b: different strings for one person or organisation that don't merely look identical.

    Nulls and empty strings name nobody. Entities of other types, and those of
    which neither a row nor a token tells the type, have no rows. Repeated rows
    change nothing. All pairs of an entity are listed, however many; only where
    ``expanded`` is given, an entity with more spellings pairs each with its most
    common one.
    """
    names = materialize(parsed(spellings(triples, raw_triples), alias_map(name_aliases)))
    nodes = names.select("node").where("node <> ''").distinct()
    edges = links(candidates(nodes), names)
    e = materialize(entities(names, edges).where(F.col("type").isin("PERSON", "ORG")).select("entity", "name", "look", "n"))
    size = e.groupBy("entity").agg(F.count(F.lit(1)).alias("size"), F.max_by(F.struct("name", "look"), F.struct("n", "name")).alias("top"))
    x = e.join(size.where("size > 1"), "entity")
    small = x if expanded is None else x.where(F.col("size") <= expanded)
    last = F.floor((F.col("size") - 1) / PART)
    left = small.select("entity", F.pmod(F.xxhash64("name"), last + 1).alias("part"), F.col("name").alias("x"), F.col("look").alias("lx"))
    right = small.select("entity", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"), F.col("name").alias("y"), F.col("look").alias("ly"))
    full = left.join(right, ["entity", "part"]).where("x < y and lx <> ly")
    if expanded is None:
        return full.select(F.col("x").alias("name_a"), F.col("y").alias("name_b"))
    star = x.where(F.col("size") > expanded).where("look <> top.look").select(F.least("name", "top.name").alias("x"), F.greatest("name", "top.name").alias("y"))
    return full.select("x", "y").unionByName(star).select(F.col("x").alias("name_a"), F.col("y").alias("name_b"))


def name_entities(triples: DataFrame, raw_triples: DataFrame, name_aliases: DataFrame) -> DataFrame:
    """(name, entity, type): one row for every spelling of a person or organisation, with the entity's smallest token string."""
    names = materialize(parsed(spellings(triples, raw_triples), alias_map(name_aliases)))
    edges = links(candidates(names.select("node").where("node <> ''").distinct()), names)
    return entities(names, edges).where(F.col("type").isin("PERSON", "ORG")).select("name", "entity", "type")
