"""Toxicity scores: gradient-boosted trees over dense features with isotonic calibration."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwood.llm import common
from tarnwood.llm.gbt import Boosted, Isotonic

#: Labelled rows that are fitted on, those of the least hash; the bound of the sample.
SAMPLE_ROWS = 24_000
#: Terms of the learned lexicon at most: the size of the model, not of the data.
LEXICON_TERMS = 4_000

# Second-person words of the languages, and the signs that stand for letters.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes tú ti tuyo vosotros".split()
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}

_LEET = str.maketrans(LEET)
_UPPER, _PUNCT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_EDGE = "".join(map(chr, _PUNCT))
STEMS = (4, 5, 6)
NEAR = 4
FEATURES = ("hits", "hit_density", "weight_density", "top_weight", "distinct_hits", "stem_hits", "stem_density", "distinct_stems", "near_second_person", "second_person_density", "capitals", "all_caps_words", "punctuation", "exclamations", "obfuscation", "obfuscated_hits", "log_words")


def terms_of(word: bytes) -> tuple[str, list[str]]:
    """The bare word and its stems, which stand for inflected forms."""
    bare = word.decode("utf-8", "replace").lower().strip(_EDGE)
    return bare, [f"{bare[:n]}~" for n in STEMS if len(bare) > n]


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)


class WordCodes(dict):
    """What a word adds to the features: (hit weight, stem weight, flags, term number)."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.second = set(SECOND_PERSON)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= common.CACHE_WORDS:
            self.clear()
        bare, stems = terms_of(word)
        weight = self.lexicon.words.get(bare, 0.0)
        stem = max((self.lexicon.stems.get(s, 0.0) for s in stems), default=0.0)
        letters = any(map(str.isalpha, bare))
        odd = letters and not bare.replace("-", "").replace("'", "").isalpha()
        plain = "".join(filter(str.isalpha, bare.translate(_LEET))) if odd else ""
        hidden = odd and self.lexicon.words.get(plain, 0.0) > 0
        raw = word.decode("utf-8", "replace")
        caps = len(bare) > 1 and raw.strip(_EDGE).isupper()
        flags = (weight > 0) | (stem > 0) << 1 | (bare in self.second) << 2 | odd << 3 | hidden << 4 | caps << 5
        code = 0
        if flags:  # weights in hundredths, then the flags, then a number of the term
            number = xxhash.xxh32_intdigest(bare if weight else max(stems, key=lambda s: self.lexicon.stems.get(s, 0.0), default="")) & 0xFFFF
            code = flags | min(int(weight * 100), 4095) << 8 | min(int(stem * 100), 4095) << 20 | number << 32
        self[word] = code
        return code


def features(texts: list[str | None], codes: WordCodes) -> np.ndarray:
    """A row of FEATURES for each text, over the whole text; an empty one has zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for row, text in zip(out, texts, strict=True):
        data = (text or "").encode("utf-8", "replace")
        words = data.split()
        if not words:
            continue
        n, size = len(words), len(data)
        got = np.fromiter(map(codes.__getitem__, words), np.int64, n)
        at = np.flatnonzero(got)
        got = got[at]
        flag = lambda bit: at[(got >> bit) & 1 > 0]
        hit, stem, second = flag(0), flag(1), flag(2)
        weights = (got[got & 1 > 0] >> 8) & 0xFFF
        near = 0
        if len(second) and (len(hit) or len(stem)):
            marked = np.union1d(hit, stem)
            i = np.searchsorted(second, marked)
            gap = np.minimum(np.abs(marked - second[np.minimum(i, len(second) - 1)]), np.abs(marked - second[np.maximum(i - 1, 0)]))
            near = int((gap <= NEAR).sum())
        row[:] = (
            len(hit), len(hit) / n, weights.sum() / 100 / n, weights.max(initial=0) / 100, len(np.unique(got[got & 1 > 0] >> 32)),
            len(stem), len(stem) / n, len(np.unique(got[got & 2 > 0] >> 32)), near, len(second) / n,
            (size - len(data.translate(None, _UPPER))) / size, len(flag(5)) / n, (size - len(data.translate(None, _PUNCT))) / size, data.count(b"!") / n,
            len(flag(3)) / n, len(flag(4)), math.log(n),
        )
    return out


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted
    calibrate: Isotonic

    def score(self, texts: list[str | None], codes: WordCodes) -> np.ndarray:
        return self.calibrate(self.trees.raw(features(texts, codes)))


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most `rows` labelled documents, those whose id has the least hash.

    The lexicon's counts are made on the executors; the driver gets the terms with the
    strongest association, LEXICON_TERMS at most, and one row of features a sampled
    document. Terms are counted once a family of near copies (documents with the same
    least five-word shingle), so that a document with many copies teaches no words.
    Rows with a null id, text or label are left out; without labels the model answers 0."""
    chosen = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("__tw_y")).where(F.col(id_col).isNotNull() & F.col("__tw_y").isin(0, 1))
    chosen = chosen.dropDuplicates([id_col]).orderBy(F.xxhash64(id_col), id_col).limit(rows)
    sample = documents.select(id_col, text_col).where(F.col(text_col).isNotNull()).join(F.broadcast(chosen), id_col)  # at most `rows` ids
    folded = T.StructType([common.field(sample, id_col), T.StructField("y", T.IntegerType()), T.StructField("family", T.LongType()), T.StructField("terms", T.ArrayType(T.StringType()))])

    def fold():
        cache = common.WordHashes()

        def work(columns):
            family, terms = [], []
            for text in columns[1]:
                words = text.encode("utf-8", "replace").split()
                h = common.hash_words(words, cache)
                if len(h) >= 5:
                    with np.errstate(over="ignore"):
                        h = common.mix(h[:-4] + h[1:-3] * np.uint64(3) + h[2:-2] * np.uint64(5) + h[3:-1] * np.uint64(7) + h[4:] * np.uint64(11))
                family.append(int(h.min() >> np.uint64(1)) if len(h) else 0)
                own = set()
                for word in set(words):
                    bare, stems = terms_of(word)
                    own.update([bare, *stems])
                terms.append(sorted(own - {""}))
            return columns[0], columns[2], family, terms

        return work

    rows_ = common.map_arrow(sample, [id_col, text_col, "__tw_y"], folded, fold)
    kept = common.written(rows_, "toxicity-sample")
    one = kept.groupBy("family", "y").agg(F.min_by("terms", id_col).alias("terms"))
    totals = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n1:
        return Model(Lexicon(), Boosted(cuts=[np.array([0.0])] * len(FEATURES), base=-30.0), Isotonic(np.array([0.0]), np.array([0.0])))
    counted = one.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0"))
    odds = F.log((F.col("c1") + 0.5) / (n1 + 1)) - F.log((F.col("c0") + 0.5) / (n0 + 1))
    least = max(3, int(0.002 * n1))
    strong = counted.where(F.col("c1") >= least).withColumn("w", odds).where(F.col("w") >= 1.5).orderBy(F.desc(F.col("c1") * F.col("w")), "term").limit(LEXICON_TERMS).collect()
    lexicon = Lexicon({r["term"]: r["w"] for r in strong if not r["term"].endswith("~")}, {r["term"]: r["w"] for r in strong if r["term"].endswith("~")})

    schema = T.StructType([common.field(sample, id_col), T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def make():
        codes = WordCodes(lexicon)
        return lambda columns: (columns[0], columns[2], features(columns[1], codes).tolist())

    table = common.map_arrow(sample, [id_col, text_col, "__tw_y"], schema, make).select("y", "x", F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)).alias("fold")).orderBy(F.xxhash64(id_col), id_col).collect()
    x, y, part = np.array([r["x"] for r in table]), np.array([r["y"] for r in table], float), np.array([r["fold"] for r in table])
    out = np.zeros(len(y))  # every row is calibrated by a model that has not seen it
    for k in range(5):
        held = part == k
        if held.any() and (~held).any():
            out[held] = Boosted().fit(x[~held], y[~held]).raw(x[held])
    return Model(lexicon, Boosted().fit(x, y), Isotonic().fit(out, y))


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id, score (0 to 1) and predicted (1 from `threshold` on) of every row.

    Null and empty texts get the model's score of zero features. Repeated rows and null
    ids get a row each; other columns are not read. One narrow pass."""
    schema = T.StructType([common.field(documents, id_col), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def make():
        codes = WordCodes(model.lexicon)

        def work(columns):
            values = model.score(columns[1], codes)
            return columns[0], values.tolist(), (values >= threshold).astype(int).tolist()

        return work

    return common.map_arrow(documents, [id_col, text_col], schema, make)


def keep_clean(documents: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows whose text scores under `threshold`, all columns as they were."""
    names = documents.columns
    schema = T.StructType(list(documents.schema.fields))

    def make():
        codes, at = WordCodes(model.lexicon), names.index(text_col)

        def work(columns):
            keep = np.flatnonzero(model.score(columns[at], codes) < threshold)
            return [[c[i] for i in keep] for c in columns]

        return work

    return common.map_arrow(documents, names, schema, make)
