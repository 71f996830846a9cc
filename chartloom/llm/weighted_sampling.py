"""Document fingerprints by consistent weighted sampling, in DataFrame expressions only.

A text's terms are its words (lower-cased runs of ASCII letters, digits and signs beyond ASCII; a text without any is one term
itself), a term's weight S how often it occurs.  For each of SAMPLES samples a term draws r and c from Gamma(2, 1) and b from
the unit interval, all from hashes of the term alone, and

    t = floor(ln S / r + b),    a = c / exp(r (t - b + 1)).

The sample is the term of the least a with its t.  Two texts take the same sample with a probability of their generalised
Jaccard similarity, the sum of the smaller weights over the sum of the larger.  Since a is a function of the term and t, equal
samples are equal least values of a, so that a plain minimum by position is the sample and no argument need be carried.

The samples of a block share r and b of a term and differ in c.  Each sample keeps the probability above, as that is a
statement about one sample; only the spread of their mean is a little wider (blocks are many for that reason).

A fingerprint is 4 hex digits for each sample; likeness is the share of equal positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.ordered import dealt, following
from chartloom.llm.runtime import materialize, pick

BLOCKS, A_BLOCK = 8, 8
SAMPLES = BLOCKS * A_BLOCK
_DIGITS = 4
_KEY = ["known", "id", "hash"]
_BETWEEN_WORDS, _IN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"


def _unit(h: Column, shift: int, bits: int) -> Column:
    """A number inside (0, 1) from bits of h."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND((1 << bits) - 1).cast("double") + 0.5) * (2.0**-bits)


def _words(text: Column) -> Column:
    return F.when(F.lower(text).rlike(_IN_WORDS), F.split(F.lower(text), _BETWEEN_WORDS)).otherwise(F.array(text))


def sampled(texts: DataFrame, keys: list[str], sides: list[str]) -> DataFrame:
    """(keys, <side>_samples array<double> for each of sides): the least a by sample, null in all places for an empty text.

    texts has one row for each value of keys, which must not be null, and a text column for each of sides.  Where texts is
    already dealt by some of keys, no step here deals rows anew.
    """
    numbered = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.coalesce(F.col(s), F.lit("")).alias("text")) for i, s in enumerate(sides)]))
    rows = texts.select(*keys, numbered.alias("own")).select(*keys, "own.side", F.explode(_words(F.col("own.text"))).alias("word"))
    rows = rows.select(*keys, "side", F.xxhash64("word").alias("term"), (F.col("word") != "").alias("any"))
    weights = [F.count(F.when((F.col("side") == i) & F.col("any"), True)).cast("double").alias(f"w{i}") for i in range(len(sides))]
    terms = rows.groupBy(*keys, "term").agg(*weights)
    n = range(len(sides))
    drawn = terms.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).withColumn("seed", F.xxhash64("term", "block"))
    drawn = drawn.withColumn("r", -F.ln(_unit(F.col("seed"), 0, 21) * _unit(F.col("seed"), 21, 21))).withColumn("b", _unit(F.col("seed"), 42, 21))
    level = lambda w: F.when(w == 0, float("inf")).otherwise(F.exp(-F.col("r") * (F.floor(F.ln(w) / F.col("r") + F.col("b")) - F.col("b") + 1.0)))
    drawn = drawn.select(*keys, "block", "seed", *[level(F.col(f"w{i}")).alias(f"e{i}") for i in n])
    hashed = drawn.select(*keys, "block", *[f"e{i}" for i in n], *[F.xxhash64("seed", F.lit(j)).alias(f"h{j}") for j in range(A_BLOCK)])
    c = lambda j: -F.ln(_unit(F.col(f"h{j}"), 0, 31) * _unit(F.col(f"h{j}"), 32, 31))
    drawn = hashed.select(*keys, "block", *[f"e{i}" for i in n], *[c(j).alias(f"c{j}") for j in range(A_BLOCK)])
    least = drawn.groupBy(*keys, "block").agg(*[F.min(F.col(f"c{j}") * F.col(f"e{i}")).alias(f"a{i}_{j}") for i in n for j in range(A_BLOCK)])
    held = least.groupBy(*keys).agg(*[F.sort_array(F.collect_list(F.struct("block", F.array(*[f"a{i}_{j}" for j in range(A_BLOCK)]).alias("a")))).alias(f"x{i}") for i in n])
    empty = lambda x: F.when(x == float("inf"), None).otherwise(x)
    return held.select(*keys, *[F.transform(F.flatten(F.col(f"x{i}.a")), empty).alias(f"{s}_samples") for i, s in enumerate(sides)])


def fingerprint(samples: Column) -> Column:
    """4 hex digits for each sample; those of an empty text are all 0."""
    digits = lambda a: F.when(a.isNull(), "0" * _DIGITS).otherwise(F.lower(F.lpad(F.hex(F.xxhash64(a).bitwiseAND((1 << 4 * _DIGITS) - 1)), _DIGITS, "0")))
    return F.array_join(F.transform(samples, digits), "")


def likeness(one: Column, other: Column) -> Column:
    """The share of samples that two fingerprints have in common."""
    at = lambda x, i: F.substr(x, i * _DIGITS + 1, F.lit(_DIGITS))
    same = F.filter(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda i: at(one, i) == at(other, i))
    return F.size(same) / F.lit(float(SAMPLES))


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_chars, fingerprint), one row a row.  Null texts are empty; equal texts have equal
    fingerprints; rows that share a doc_id have one each; an empty table gives no rows."""
    rows = _keyed(docs)
    texts = rows.groupBy(*_KEY).agg(F.first("text").alias("text"))
    found = sampled(texts, _KEY, ["text"]).select(*_KEY, fingerprint(F.col("text_samples")).alias("fingerprint"))
    out = rows.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), *_KEY).join(found, _KEY)
    return out.drop(*_KEY)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with known, id, hash: null ids before all others, then by id, rows of one id by a hash of the text."""
    rows = pick(docs, doc_id="bigint", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select("doc_id", "text", F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("hash"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of an edited text, and how alike they are:

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    In the edited text the last floor(n_chars / 4) code points give way to the first as many (or all) of the next document,
    in ascending doc_id; after the last comes the first.  near_next compares with the next document.  Null texts are empty;
    a null doc_id stands before all others; rows that share a doc_id all have the same next document, which is the row of the
    next id whose text has the least hash; equal rows give equal rows.  One document alone is its own next one; an empty table
    gives no rows.

    Texts are dealt once, by id and hash; that exchange serves both joins, and all sampling runs in its partitions.
    """
    rows = _keyed(docs)
    keys = rows.select(*_KEY, F.length("text").alias("n")).distinct()
    ids = dealt(keys.groupBy("known", "id").agg(F.min("hash").alias("hash")), [F.col("known"), F.col("id")], "document-order")
    order = following(ids, ["known", "id"], ["hash"]).drop("hash")
    pairs = materialize(keys.join(order, ["known", "id"]), "document-pairs")

    # the filter, which all rows pass, keeps copies on both sides of what follows, so that both read one exchange
    texts = rows.groupBy(*_KEY).agg(F.first("text").alias("text"), F.count("*").alias("copies")).where("copies > 0")
    nexts = [F.col(f"next_{k}").alias(k) for k in _KEY]
    asked = pairs.select(*nexts, *[F.col(k).alias(f"of_{k}") for k in _KEY], F.expr("n div 4").cast("int").alias("most"))
    heads = texts.join(asked, _KEY).select(*[F.col(f"of_{k}").alias(k) for k in _KEY], F.substr("text", F.lit(1), F.col("most")).alias("head"))
    edited = F.concat(F.substr("text", F.lit(1), (F.length("text") - F.expr("length(text) div 4")).cast("int")), "head")
    both = texts.join(heads, _KEY).select(*_KEY, "copies", "text", edited.alias("edited"))

    prints = sampled(both, _KEY, ["text", "edited"]).select(*_KEY, fingerprint(F.col("text_samples")).alias("fingerprint"), fingerprint(F.col("edited_samples")).alias("edited_fingerprint"))
    facts = both.select(*_KEY, "copies", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    held = materialize(facts.join(prints, _KEY), "fingerprints")

    out = held.join(pairs.drop("n"), _KEY).withColumnsRenamed({k: f"own_{k}" for k in _KEY})
    other = held.select(*[F.col(k).alias(f"next_{k}") for k in _KEY], F.col("fingerprint").alias("next_fingerprint"))
    out = out.join(other, [f"next_{k}" for k in _KEY])
    return out.select(
        F.when(F.col("own_known"), F.col("own_id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.explode(F.expr("sequence(1L, copies)")).alias("copy"),
    ).drop("copy")
