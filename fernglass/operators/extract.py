"""Relations from parsed sentences, their normal forms, and their quality.

A parse is a token table (passage_id, sentence_index, i, text, lemma, pos, tag,
dep, head_i), ``i`` counting within the passage; any parser that writes it can be
used. Patterns are joins of tokens with their heads within a sentence.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from fernglass.functions import text as T
from fernglass.operators.evaluate import wilson
from fernglass.runtime import is_empty, materialize

S = ["passage_id", "sentence_index"]
DEEPEST = 64  # levels of a parse tree, beyond which it is taken for a cycle


def closure(tokens: DataFrame, follow, most: int = DEEPEST) -> DataFrame:
    """(passage_id, sentence_index, root, i): each token with all it reaches over children for which ``follow`` holds, itself included."""
    child = materialize(tokens.where(follow & (F.col("head_i") != F.col("i"))).select(*S, F.col("head_i").alias("via"), "i"))
    step = materialize(tokens.select(*S, F.col("i").alias("root"), "i"))
    out = step
    for _ in range(most):
        step = materialize(step.withColumnRenamed("i", "via").join(child, [*S, "via"]).select(*S, "root", "i"))
        if is_empty(step):
            return out
        out = out.unionByName(step)
    raise ValueError(f"a parse is more than {most} levels deep, or has a cycle")


def phrases(tokens: DataFrame) -> DataFrame:
    """(passage_id, sentence_index, i, phrase): the text of each token's phrase: its subtree without conjuncts, leading determiners trimmed.

    A phrase of determiners only is reduced to its token.
    """
    span = closure(tokens, ~F.col("dep").isin("cc", "conj")).groupBy(*S, "root").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    word = tokens.select(*S, F.col("i").alias("j"), "text", "pos")
    x = span.join(word, S).where(F.col("j").between(F.col("lo"), F.col("hi")))
    first = F.min(F.when(F.col("pos") != "DET", F.col("j")))
    per = x.groupBy(*S, "root").agg(first.alias("first"), F.sort_array(F.collect_list(F.struct("j", "text"))).alias("w"))  # one phrase's words
    kept = F.filter("w", lambda e: F.when(F.col("first").isNull(), e["j"] == F.col("root")).otherwise(e["j"] >= F.col("first")))
    return per.select(*S, F.col("root").alias("i"), F.array_join(F.transform(kept, lambda e: e["text"]), " ").alias("phrase"))


def conjuncts(tokens: DataFrame) -> DataFrame:
    """(passage_id, sentence_index, head, i): each token and all conjoined to it."""
    return closure(tokens, F.col("dep") == "conj").withColumnRenamed("root", "head")


def relations(tokens: DataFrame) -> DataFrame:
    """(passage_id, sentence_index, subject_text, relation, object_text, pattern) of all sentences that aren't questions.

    Patterns: active (subject, verb, direct object), passive with an agent (the
    agent is the subject), copular (a form of "be" with an attribute) and, for
    verbs without a direct object, verb with preposition. Conjoined subjects and
    objects give a row each; relative pronouns are no subjects.
    """
    last = F.max_by("text", "i")
    asks = tokens.groupBy(*S).agg(last.alias("t")).where(F.col("t").endswith("?")).select(*S)
    t = materialize(tokens.join(asks, S, "left_anti"))
    c = materialize(conjuncts(t))
    p = materialize(phrases(t))
    pick = lambda cond, name: t.where(cond).select(*S, F.col("head_i").alias(f"{name}_head"), F.col("i").alias(name), F.lower("text").alias(f"{name}_text"))
    own = ~F.coalesce(F.col("tag").isin("WDT", "WP"), F.lit(False))
    verb = t.select(*S, F.col("i").alias("v"), F.col("pos").alias("vpos"), F.col("lemma").alias("lemma"))
    subj = pick((F.col("dep") == "nsubj") & own, "s").withColumnRenamed("s_head", "v").join(verb, [*S, "v"])
    passive = pick((F.col("dep") == "nsubjpass") & own, "s").withColumnRenamed("s_head", "v").join(verb, [*S, "v"])
    dobj = pick(F.col("dep") == "dobj", "o").withColumnRenamed("o_head", "v")
    attr = pick(F.col("dep") == "attr", "o").withColumnRenamed("o_head", "v")
    pobj = pick(F.col("dep") == "pobj", "o")
    agent = pick(F.col("dep") == "agent", "g").withColumnRenamed("g_head", "v").join(pobj.withColumnRenamed("o_head", "g"), [*S, "g"])
    prep = pick(F.col("dep") == "prep", "r").withColumnRenamed("r_head", "v").join(pobj.withColumnRenamed("o_head", "r"), [*S, "r"])
    is_verb = F.col("vpos") == "VERB"
    found = [
        subj.where(is_verb).join(dobj, [*S, "v"]).select(*S, "s", "o", F.col("lemma").alias("relation"), F.lit("active_svo").alias("pattern")),
        passive.where(is_verb).join(agent, [*S, "v"]).select(*S, F.col("o").alias("s"), F.col("s").alias("o"), F.col("lemma").alias("relation"), F.lit("passive").alias("pattern")),
        subj.where(F.col("lemma") == "be").join(attr, [*S, "v"]).select(*S, "s", "o", F.col("lemma").alias("relation"), F.lit("copular").alias("pattern")),
        subj.where(is_verb).join(dobj.select(*S, "v"), [*S, "v"], "left_anti").join(prep, [*S, "v"]).select(*S, "s", "o", F.concat_ws(" ", "lemma", "r_text").alias("relation"), F.lit("prep_object").alias("pattern")),
    ]
    x = reduce(DataFrame.unionByName, found)
    x = x.join(c.select(*S, F.col("head").alias("s"), F.col("i").alias("si")), [*S, "s"]).join(c.select(*S, F.col("head").alias("o"), F.col("i").alias("oi")), [*S, "o"])
    x = x.join(p.select(*S, F.col("i").alias("si"), F.col("phrase").alias("subject_text")), [*S, "si"]).join(p.select(*S, F.col("i").alias("oi"), F.col("phrase").alias("object_text")), [*S, "oi"])
    return x.select(*S, "subject_text", "relation", "object_text", "pattern")


def normalize_relations(raw: DataFrame, corpus: DataFrame) -> DataFrame:
    """``raw`` with subject and object normalized by the passage's title: pronouns and the title's own names become the title.

    Relations of unknown passages stay as they are; nulls stay null.
    """
    x = raw.join(corpus.select("passage_id", F.col("title").alias("_t")), "passage_id", "left")
    x = x.withColumn("subject", T.normalize_surface(F.col("subject_text"), F.col("_t"))).withColumn("object", T.normalize_surface(F.col("object_text"), F.col("_t")))
    return x.drop("_t", "subject_text", "object_text")


def attach_types(raw: DataFrame, entities: DataFrame) -> DataFrame:
    """``raw`` (with a unique raw_id) with subject_type and object_type: the label of the longest entity of the sentence that the raw text contains.

    Both are compared folded; of equally long entities the first one counts.
    """
    e = entities.select(*S, T.fold_case("text").alias("e"), F.length("text").alias("n"), "label", "start").where(F.length("e") > 0)
    out = raw
    for side in ("subject", "object"):
        x = raw.select("raw_id", *S, T.fold_case(f"{side}_text").alias("f")).join(e, S).where(F.contains("f", "e"))
        best = x.groupBy("raw_id").agg(F.max_by("label", F.struct("n", -F.col("start"))).alias(f"{side}_type"))
        out = out.join(best, "raw_id", "left")
    return out


def triples_of_parse(tokens: DataFrame, entities: DataFrame, corpus: DataFrame) -> DataFrame:
    """(subject, relation, object, passage_id, sentence_index, subject_type, object_type, pattern) of parsed sentences: relations, their types, then their normal form; each once."""
    raw = relations(tokens).distinct()
    raw = materialize(raw.withColumn("raw_id", F.sha2(F.to_json(F.struct(*raw.columns)), 256)))
    x = normalize_relations(attach_types(raw, entities), corpus)
    return x.select("subject", "relation", "object", "passage_id", "sentence_index", "subject_type", "object_type", "pattern").distinct()


def relation_histogram(triples: DataFrame) -> DataFrame:
    """(relation, n)."""
    return triples.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def _contained(a: str, b: str) -> bool:
    return a in b or b in a


def greedy_matches(gold: DataFrame, extracted: DataFrame) -> DataFrame:
    """(passage_id, sentence_index, n_gold, n_extracted, n_correct) of every sentence that gold covers.

    Within a sentence, gold triples in the order of ``pos`` take the first
    extracted one, in the order of ``pos``, that has the same folded relation and
    whose subject and object contain the gold ones or are contained in them; each
    is taken once. Since relations must agree, relations of a sentence are matched
    apart. Triples with a null match nothing. Both need a column ``pos``.
    """
    fold = lambda d: d.select(*S, "pos", T.fold_case("subject").alias("s"), T.fold_case("relation").alias("r"), T.fold_case("object").alias("o"))
    g = fold(gold)
    e = fold(extracted).join(g.select(*S).distinct(), S, "left_semi")
    lists = lambda d, name: d.where("s is not null and r is not null and o is not null").groupBy(*S, "r").agg(F.sort_array(F.collect_list(F.struct("pos", "s", "o"))).alias(name))

    @F.pandas_udf(LongType())
    def taken(gold_side: pd.Series, other: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(gold_side, other, strict=True):
            left, hit = [(x["s"], x["o"]) for x in b], 0
            for x in a:
                for i, (s2, o2) in enumerate(left):
                    if _contained(x["s"], s2) and _contained(x["o"], o2):
                        hit += 1
                        del left[i]
                        break
            out.append(hit)
        return pd.Series(out, dtype="int64")

    hits = lists(g, "a").join(lists(e, "b"), [*S, "r"]).select(*S, taken("a", "b").alias("hit")).groupBy(*S).agg(F.sum("hit").alias("n_correct"))
    n = g.groupBy(*S).agg(F.count(F.lit(1)).alias("n_gold")).join(e.groupBy(*S).agg(F.count(F.lit(1)).alias("n_extracted")), S, "left").join(hits, S, "left")
    return n.select(*S, "n_gold", F.coalesce("n_extracted", F.lit(0)).alias("n_extracted"), F.coalesce("n_correct", F.lit(0)).alias("n_correct"))


def quality(matches: DataFrame) -> DataFrame:
    """One row: counts, and precision and recall with their intervals."""
    x = matches.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_gold", "n_extracted", "n_correct")])
    p, r = wilson(F.col("n_correct"), F.col("n_extracted")), wilson(F.col("n_correct"), F.col("n_gold"))
    names = ("", "_low", "_high")
    return x.select("*", *[c.alias(f"precision{n}") for c, n in zip(p, names, strict=True)], *[c.alias(f"recall{n}") for c, n in zip(r, names, strict=True)])


def annotate(texts: DataFrame, schema: str, load, apply) -> DataFrame:
    """Rows of a parser or recogniser over texts: ``load()`` once a worker, ``apply(model, pandas frame)`` a batch."""

    def run(batches):
        model = load()
        for pdf in batches:
            yield apply(model, pdf)

    return texts.mapInPandas(run, schema)
