"""Secret scans with false-positive removal by a random forest.

A pass over the texts lists candidates: long runs of key characters that are not plain words, and values assigned to
names such as ``password``. A candidate becomes a row of numbers: its length, its character classes and the transitions
between them, how likely its letter pairs are in the corpus's words, how much of it dictionary words cover, its path
and the words around it. A random forest, trained on labelled findings, says which candidates are secrets.

Labelled findings are a table (doc_id, start, end, label). ``marked`` makes one from formats alone where no hand-made
labels exist: fixed key formats, signed tokens, private key blocks and random-looking values that are assigned to a
credential's name, simple or compound (``db_password``, ``clientSecret``), count as secrets; numbers, words, addresses, paths and placeholders do not.

Defined cases: null counts as empty; a null path is ""; starts and ends are code points, from 0; texts are read whole
and every candidate is a row, overlapping ones once; repeated rows have rows each; labels of one class only give every
candidate their share of secrets as its score; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .common import bucket, hash_share, release, store, texts

RUN = re.compile(r"[A-Za-z0-9+/_\-]{12,}={0,2}")
SIGN = re.compile(r"=>|[:=]{1,2}")
VALUE = re.compile(r"\s*[\"']?(?:(?:bearer|basic|token)\s+)?([^\s\"'<>]{6,})", re.I)
BEFORE = re.compile(r"([A-Za-z_\-][A-Za-z0-9_\-]*)[\"']?\s*(?:([:=]{1,2}|=>)\s*[\"']?(?:(?:bearer|basic|token)\s+)?|[\"']?)$", re.I)
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
WORDS = re.compile(r"[A-Za-z]+")
AROUND = 48  # characters on each side that are searched for neighbouring words
CREDENTIAL = frozenset("password passwd passphrase pwd pass secret token key apikey api auth credential credentials bearer authorization login aws private access".split())
# A compound name is a credential's by one of these, or by "key" at its end unless what comes before says otherwise.
DECISIVE = frozenset("password passwd passphrase pwd pass secret secrets token apikey auth credential credentials bearer authorization".split())
GLUED = ("password", "passwd", "passphrase", "secret", "token", "apikey", "accesskey", "secretkey", "privatekey", "authkey")
NO_SECRET_KEY = frozenset("primary foreign public sort partition cache index unique row group shard join lookup map object idempotency".split())
FAKE = frozenset("example sample test dummy fake placeholder changeme your xxx todo foo bar demo mock".split())
HARMLESS = frozenset("commit sha sha1 sha256 md5 hash checksum digest uuid guid id card number phone isbn order invoice version build mail email http https www url".split())
PATH_TEST = frozenset("test tests example examples sample samples doc docs fixture fixtures mock spec demo".split())
PATH_CONFIG = frozenset("env config conf ini yml yaml properties settings secrets credentials key pem".split())
KEY_FORMAT = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_\-]{35}|sk_live_[A-Za-z0-9]{16,}|glpat-[A-Za-z0-9_\-]{20})(?![A-Za-z0-9])")
JWT = re.compile(r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}")
# Up to its end mark, or as far as key lines go where the text is cut off.
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----(?:(?:[^-]|-(?!----)){32,20000}-----END [A-Z0-9 ]*-----|(?:(?:\s|\\n)*[A-Za-z0-9+/=]{16,})+)")
HEX = re.compile(r"[0-9a-f]{12,}|[0-9A-F]{12,}")
CLASSES = 5  # lower, upper, digit, mark, end
N_FEATURES = 12 + CLASSES * CLASSES + 13


@dataclass
class Language:
    """Words of the corpus and the logarithms of their letter pairs' shares."""

    words: frozenset[str]
    pairs: np.ndarray


def pair_counts(words: Iterable[str], counts: Iterable[int]) -> np.ndarray:
    """How often each two letters follow each other in the words."""
    pairs = np.zeros((26, 26), np.int64)
    for w, n in zip(words, counts):
        for a, b in zip(w, w[1:]):
            pairs[ord(a) - 97, ord(b) - 97] += n
    return pairs


def learn_language(docs: DataFrame, max_words: int = 300_000, least: int = 3) -> Language:
    """From the words of all documents that occur ``least`` times in them; longer ones than ``AROUND`` letters, which no
    feature can look up, are none. Letter pairs are counted over all of these words. Of the words, which are broadcast,
    those in the most documents are taken where there are more than ``max_words``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        in_docs: Counter = Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"word": list(n), "n": list(n.values()), "docs": [in_docs[w] for w in n]})
            n.clear()
            in_docs.clear()
            return out

        for b in batches:
            for t in texts(b["text"]):
                own = Counter(w.lower() for w in WORDS.findall(t) if len(w) <= AROUND)
                n.update(own)
                in_docs.update(own.keys())
                if len(n) > 200_000:
                    yield flush()
        if n:
            yield flush()
        release()

    def pairs_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = sum((pair_counts(b["word"], b["n"]) for b in batches), np.zeros((26, 26), np.int64)).ravel()
        yield pd.DataFrame({"pair": np.flatnonzero(total), "n": total[total > 0]})

    rows = docs.select("text").mapInPandas(count, "word string, n long, docs long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = store(rows.where(F.col("n") >= least), "secrets-words")
    pairs = np.ones(26 * 26)
    for r in rows.mapInPandas(pairs_of, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r["pair"]] += r["n"]
    pairs = pairs.reshape(26, 26)
    words = _most_common(rows.where(F.length("word") >= 3), max_words)
    return Language(frozenset(words.select("word").toPandas()["word"]), np.log(pairs / pairs.sum(1, keepdims=True)))


def _most_common(words: DataFrame, bound: int) -> DataFrame:
    """The words in at least so many documents that no more than ``bound`` are left."""
    step = F.floor(F.log2("docs") * 8).cast("int")
    have, at = 0, None
    for r in words.groupBy(step.alias("step")).count().orderBy(F.col("step").desc()).collect():
        if have + r["count"] > bound:
            return words.where(step >= at) if at is not None else words.limit(0)
        have, at = have + r["count"], r["step"]
    return words


def _class(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


def credential_name(name: str) -> bool:
    """Whether a name, cut at marks and changes of case, is that of a credential."""
    parts = [p.lower() for p in PARTS.findall(name)]
    if not parts or parts[-1] in HARMLESS:
        return False
    if DECISIVE.intersection(parts) or parts[-1].endswith(GLUED):
        return True
    return len(parts) > 1 and parts[-1] in ("key", "keys") and not NO_SECRET_KEY.intersection(parts)


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that might be secrets, in order; overlapping ones are one."""
    found = set()
    for m in RUN.finditer(text):
        v = m.group()
        if any(c.isdigit() for c in v) or (v[1:] != v[1:].lower() and v != v.upper()) or KEY_FORMAT.search(v):
            found.add(m.span())
    for m in SIGN.finditer(text):
        name = BEFORE.search(text[max(0, m.start() - AROUND):m.start()])
        value = VALUE.match(text, m.end()) if name and not name[2] and credential_name(name[1]) else None
        if value:
            found.add(value.span(1))
    if "eyJ" in text:
        found.update(m.span() for m in JWT.finditer(text))
    if "PRIVATE KEY" in text:
        found.update(m.span() for m in PEM.finditer(text))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _coverage(value: str, words: frozenset[str]) -> float:
    """Share of the letters that the longest dictionary words cover, from left to right."""
    low, at, hit = value.lower(), 0, 0
    while at < len(low):
        for n in range(min(16, len(low) - at), 2, -1):
            if low[at:at + n] in words:
                hit += n
                at += n
                break
        else:
            at += 1
    return hit / max(1, len(value))


def context(text: str, a: int, b: int) -> tuple[str, str, list[str]]:
    """The name assigned to (or ""), the sign of assignment (or "") and the neighbouring words."""
    left, right = text[max(0, a - AROUND):a], text[b:b + AROUND]
    m = BEFORE.search(left)
    words = [w.lower() for w in (*WORDS.findall(left)[-4:], *WORDS.findall(right)[:4])]
    return (m[1] if m else ""), (m[2] or "" if m else ""), words


def features(text: str, a: int, b: int, path: str, lang: Language) -> list[float]:
    v = text[a:b]
    kinds = [_class(c) for c in v]
    n = len(v)
    steps = np.zeros((CLASSES, CLASSES))
    for x, y in zip([4, *kinds], [*kinds, 4]):
        steps[x, y] += 1
    counts = Counter(v)
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    letters = [(ord(x) - 97, ord(y) - 97) for x, y in zip(v.lower(), v.lower()[1:]) if "a" <= x <= "z" and "a" <= y <= "z"]
    name, sign, around = context(text, a, b)
    near = set(around)
    parts = set(re.split(r"[^a-z0-9]+", path.lower()))
    share = [kinds.count(k) / n for k in range(4)]
    return [
        n, math.log(n), entropy, len(counts) / n, *share,
        float(np.mean([lang.pairs[p] for p in letters])) if letters else 0.0, len(letters) / n, _coverage(v, lang.words), float(HEX.fullmatch(v) is not None),
        *(steps / (n + 1)).ravel(),
        float(name.lower() in CREDENTIAL or credential_name(name)), float(key_like(v)), float(sign != ""), float(a > 0 and text[a - 1] in "\"'"), float(b < len(text) and text[b] in "\"'"),
        float(b < len(text) and text[b] == "@" or a > 0 and text[a - 1] in "@./"), float(bool(near & CREDENTIAL)), float(bool(near & FAKE)), float(bool(near & HARMLESS)),
        float(bool(parts & PATH_TEST)), float(bool(parts & PATH_CONFIG)), float(len(path)), sum(w in lang.words for w in around) / max(1, len(around)),
    ]


def scan(docs: DataFrame, lang: Language, path_col: str = "source") -> DataFrame:
    """doc_id, text_key (hash of the text), start, end, label by format and features of every candidate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, key, t, p in zip(batch["doc_id"], batch["text_key"], texts(batch["text"]), texts(batch["path"])):
                out += [(i, key, a, b, marked(t, a, b), features(t, a, b, p, lang)) for a, b in candidates(t)]
            yield pd.DataFrame(out, columns=["doc_id", "text_key", "start", "end", "by_format", "features"])
        release()

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text", F.col(path_col).cast("string").alias("path"))
    return rows.mapInPandas(run, "doc_id long, text_key long, start long, end long, by_format int, features array<double>")


def _fake(value: str) -> bool:
    return any(w in FAKE for w in re.split(r"[^a-z]+", value.lower()))


def key_like(value: str) -> bool:
    """Whether a key of a fixed format, a signed token or a private key block stands in the value."""
    return bool(PEM.search(value)) or any(not _fake(m.group()) for form in (KEY_FORMAT, JWT) for m in form.finditer(value))


def marked(text: str, a: int, b: int) -> int:
    """1 for what its format shows to be a secret, else 0."""
    v = text[a:b]
    name, sign, _ = context(text, a, b)
    if key_like(v):
        return 1
    if _fake(v):
        return 0
    mixed = any(c.isdigit() for c in v) and any(c.isalpha() for c in v)
    return int(bool(sign) and (name.lower() in CREDENTIAL or credential_name(name)) and mixed and len(v) >= 8 and len(set(v)) >= 6)


def train(found: DataFrame, labelled: DataFrame, max_findings: int = 20_000, trees: int = 40, depth: int = 8):
    """A forest from candidates that ``labelled`` (doc_id, start, end, label) names; a number if all labels agree."""
    keys = ["doc_id", "start", "end"]
    rows = found.join(labelled.select(*keys, F.col("label").cast("double")).distinct(), keys)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return float(max(counts, default=0.0))
    # at most about half of the bound for either label
    drawn = F.lit(False)
    for y, n in counts.items():
        drawn = drawn | ((F.col("label") == y) & hash_share(F.struct(*keys), n, max_findings // 2, 6))
    data = rows.where(drawn).select("label", array_to_vector("features").alias("vector")).coalesce(8)
    return RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=1, minInstancesPerNode=2).fit(data)


def score(found: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """Add score and secret (score at least ``threshold``)."""
    if isinstance(model, float):
        scored = found.withColumn("score", F.lit(model))
    else:
        model.setProbabilityCol("_p").setPredictionCol("_y").setRawPredictionCol("_r")
        scored = model.transform(found.withColumn("vector", array_to_vector("features")))
        scored = scored.withColumn("score", vector_to_array("_p")[1]).drop("_p", "_y", "_r", "vector")
    return scored.withColumn("secret", F.col("score") >= threshold)


def find(docs: DataFrame, labelled: DataFrame | None = None, path_col: str = "source") -> DataFrame:
    """doc_id, text_key, start, end, score, secret for every candidate of every document.

    Without ``labelled``, the formats label the candidates of three quarters of the documents, by their ids.
    """
    found = store(scan(docs, learn_language(docs), path_col), "secrets-candidates")
    if labelled is None:
        labelled = found.where(bucket("doc_id") != 2).select("doc_id", "start", "end", F.col("by_format").alias("label"))
    return score(found, train(found, labelled)).select("doc_id", "text_key", "start", "end", "by_format", "score", "secret")


def redact(docs: DataFrame, labelled: DataFrame | None = None, path_col: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every secret replaced by ``mark``; n_chars, where the table has it, is the new length."""
    spans = find(docs, labelled, path_col).where("secret").groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_set(F.struct("start", "end")), asc=False).alias("_spans"))
    spans = broadcast_if_small(store(spans, "secrets-spans").withColumnsRenamed({"doc_id": "_id", "text_key": "_key"}), 200_000)
    # the row as one column, so that no name of the table can clash
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "text")
    rows = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left")
    # from the last span back, so that earlier positions stay right
    cut = F.aggregate("_spans", F.col("text"), lambda t, s: F.concat(
        F.substring(t, F.lit(1), s["start"].cast("int")), F.lit(mark), F.substring(t, (s["end"] + 1).cast("int"), F.length(t))))
    new = {"text": cut, "n_chars": F.length(cut).cast("long")}
    columns = [F.when(F.col("_spans").isNotNull(), new[c]).otherwise(F.col("_row").getField(c)).alias(c) if c in new else F.col("_row").getField(c).alias(c)
               for c in docs.columns]
    return rows.select(*columns)
