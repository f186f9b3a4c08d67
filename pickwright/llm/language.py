"""Language ID with string kernels.

The kernel counts the n-grams (1 to 3 folded bytes) that two texts both hold, normalised
by their own counts. A bounded sample of labelled rows gives landmarks (Nyström) and
one-versus-rest kernel ridge regression. A text's outputs are a matrix product of its
gram presence with the landmarks' grams and coefficients, batch by batch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwright.llm.common import broadcast_if, map_texts

#: At most about so many training rows of a language are used, chosen by a hash of the id; so many of them are landmarks.
SAMPLE, LANDMARKS, RIDGE = 400, 40, 1e-3
BATCH = 128
GRAMS = 64 + 64**2 + 64**3
TRIGRAMS = GRAMS - 64**3
#: A trigram is familiar from so many sample rows of a language. A text is in the language if its share of familiar ones
#: reaches this part of what all but a few rows reach when left out, less three standard errors of the text's own share.
SEEN_IN, FEW, OF_CLEAN, ERRORS = 2, 0.01, 0.75, 3.0


def has_letter(text: str) -> bool:
    """A character of the Unicode letter categories, as ``\\p{L}``; numerals such as ½ or Ⅷ are none."""
    return any(map(str.isalpha, text))


def _folded() -> np.ndarray:
    """64 classes of bytes: ASCII letters without case, UTF-8 trail bytes by their low five bits, lead bytes by three ranges, all else one class."""
    t = np.zeros(256, np.uint32)
    for k in range(26):
        t[65 + k] = t[97 + k] = 1 + k
    t[128:192] = 27 + (np.arange(64) & 31)
    t[192:208], t[208:224], t[224:] = 59, 60, 61
    return t


_FOLD = _folded()


def grams(text: str, flags: np.ndarray) -> np.ndarray:
    """Sorted numbers of the n-grams present; ``flags`` is GRAMS cleared booleans and is left cleared."""
    c = _FOLD[np.frombuffer(text.encode(), np.uint8)]
    flags[c] = True
    if len(c) > 1:
        two = (c[:-1] << 6) | c[1:]
        flags[two + 64] = True
        if len(c) > 2:
            flags[((two[:-1] << 6) | c[2:]) + (64 + 64**2)] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


@dataclass
class Model:
    langs: list[str]
    place: np.ndarray  # gram -> row of weights, or -1
    weights: np.ndarray  # grams x languages
    familiar: np.ndarray = field(default_factory=lambda: np.zeros((0, 64**3), bool))  # languages x trigrams
    floors: list[float] = field(default_factory=list)  # least share of familiar trigrams, by language

    def outputs(self, texts: list[str]) -> np.ndarray:
        flags, out = np.zeros(GRAMS, bool), np.zeros((len(texts), len(self.langs)), np.float32)
        for at in range(0, len(texts), BATCH):
            part = texts[at : at + BATCH]
            present, norm = np.zeros((len(part), len(self.weights)), np.float32), np.ones(len(part), np.float32)
            for k, t in enumerate(part):
                g = grams(t, flags)
                norm[k] = max(1.0, len(g)) ** 0.5
                p = self.place[g]
                present[k, p[p >= 0]] = 1
            out[at : at + BATCH] = present @ self.weights / norm[:, None]
        return out

    def recognises(self, text: str, lang: str, flags: np.ndarray) -> bool:
        """The text holds as many of the language's trigrams as rows of that language do. Texts of a few bytes prove nothing and pass."""
        k = self.langs.index(lang)
        g = grams(text, flags)
        g = g[g >= TRIGRAMS] - TRIGRAMS
        floor = self.floors[k]
        return not len(g) or float(self.familiar[k][g].mean()) >= floor - ERRORS * (floor * (1 - floor) / len(g)) ** 0.5


def familiarity(names: list[str], langs: list[str], held: list[np.ndarray]) -> tuple[np.ndarray, list[float]]:
    """Trigrams familiar in each language, and the least share of them: from the shares of its rows, each measured without itself."""
    familiar, floors = np.zeros((len(names), 64**3), bool), []
    for k, name in enumerate(names):
        rows = [g[g >= TRIGRAMS] - TRIGRAMS for g, x in zip(held, langs, strict=True) if x == name]
        seen = np.zeros(64**3, np.int32)
        for g in rows:
            seen[g] += 1
        familiar[k] = seen >= SEEN_IN
        shares = [float((seen[g] > SEEN_IN).mean()) for g in rows if len(g)]
        floors.append(OF_CLEAN * float(np.quantile(shares, FEW)) if shares else 0.0)
    return familiar, floors


def fit(langs: list[str], held: list[np.ndarray], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Ridge regression in the span of the first ``landmarks`` rows of each language."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.full(GRAMS, -1, np.int32), np.zeros((0, 0), np.float32))
    taken: dict[str, int] = dict.fromkeys(names, 0)
    marks = []
    for k, x in enumerate(langs):
        if taken[x] < landmarks:
            taken[x] += 1
            marks.append(k)
    used = np.unique(np.concatenate([held[k] for k in marks]))
    place = np.full(GRAMS, -1, np.int32)
    place[used] = np.arange(len(used))

    def rows(which) -> np.ndarray:
        m = np.zeros((len(which), len(used)), np.float32)
        for i, k in enumerate(which):
            p = place[held[k]]
            m[i, p[p >= 0]] = 1 / max(1, len(held[k])) ** 0.5
        return m

    base = rows(marks)
    near = np.zeros((len(langs), len(marks)), np.float32)
    for at in range(0, len(langs), 256):
        near[at : at + 256] = rows(range(at, min(len(langs), at + 256))) @ base.T
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # every language weighs the same
    w = np.array([1 / langs.count(x) for x in langs])[:, None] * len(langs) / len(names)
    k_mm, k_nm = (base @ base.T).astype(float), near.astype(float)
    a = np.linalg.lstsq(k_nm.T @ (w * k_nm) + ridge * len(langs) * k_mm, k_nm.T @ (w * y), rcond=1e-10)[0]
    return Model(names, place, (base.T @ a).astype(np.float32), *familiarity(names, langs, held))


def remainder(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 3


def train(docs: DataFrame, doc_id: str, text: str, lang: str, sample: int = SAMPLE) -> Model:
    """Rows with a language, a letter, and a remainder other than 1. The sample's expected size is ``sample`` a language, whatever the table's."""
    own = docs.where((remainder(doc_id) != 1) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(doc_id).alias("__i"), F.col(text).alias("__t"), F.col(lang).alias("__l"))
    sizes = docs.where((remainder(doc_id) != 1) & F.col(lang).isNotNull()).groupBy(F.col(lang).alias("__sl")).agg(F.count("*").alias("__n"))
    draw = F.pmod(F.xxhash64("__i"), F.lit(1 << 30)) / float(1 << 30)
    some = own.join(broadcast_if(sizes, 10_000), F.col("__l") == F.col("__sl")).where(draw < F.lit(float(sample)) / F.col("__n"))

    def present(texts: list) -> dict[str, list]:
        flags = np.zeros(GRAMS, bool)
        return {"g": [grams(t, flags).astype("<i4").tobytes() for t in texts]}

    found = sorted(map_texts(some, ["__l", "__i"], "__t", "g binary", present).toPandas().itertuples(index=False), key=lambda r: (r[0], str(r[1])))
    return fit([r[0] for r in found], [np.frombuffer(r[2], "<i4") for r in found])


def predict_batch(model: Model, texts: list[str | None]) -> dict[str, list]:
    known = [k for k, t in enumerate(texts) if t and model.langs and has_letter(t)]
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    if known:
        out = model.outputs([texts[k] for k in known])
        best = out.argmax(axis=1)
        for k, b, s in zip(known, best.tolist(), out[np.arange(len(known)), best].tolist(), strict=True):
            lang[k], score[k] = model.langs[b], min(1.0, max(0.0, (s + 1) / 2))
    return {"lang_pred": lang, "score": score}


def identify(docs: DataFrame, keep: list[str] | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``keep`` (the id unless given), ``held_out``, ``lang_pred`` and ``score`` for every row.

    Null, empty and letterless texts, and all texts where no row could be learned from,
    are ``und`` with score 0. A null id is neither learned from nor held out. Repeated
    rows get equal results, ties go to the first language in order, an empty table gives
    an empty result. The score is the winning output, -1 to 1, as a share.
    """
    model = train(docs, doc_id, text, lang, sample)
    keep = keep or [doc_id]
    own = docs.select(*keep, F.coalesce(remainder(doc_id) == 1, F.lit(False)).alias("held_out"), F.col(text).alias("__t"))
    return map_texts(own, [*keep, "held_out"], "__t", "lang_pred string, score double", lambda texts: predict_batch(model, texts))


def recognise_batch(model: Model, texts: list[str | None]) -> dict[str, list]:
    flags = np.zeros(GRAMS, bool)
    made = predict_batch(model, texts)
    if not model.langs:
        return made | {"recognised": [bool(t and has_letter(t)) for t in texts]}
    made["recognised"] = [x != "und" and model.recognises(t, x, flags) for t, x in zip(texts, made["lang_pred"], strict=True)]
    return made


def recognised(docs: DataFrame, keep: list[str] | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``keep`` (the id unless given), ``lang_pred`` and ``recognised`` for every row: is the text in its winning language at all?

    The winning output can't tell: outputs of a text in no learned language are all near zero.
    Where no row could be learned from nothing can be told apart: every text with a letter is recognised, as ``und``.
    """
    model = train(docs, doc_id, text, lang, sample)
    keep = keep or [doc_id]
    own = docs.select(*keep, F.col(text).alias("__t"))
    return map_texts(own, keep, "__t", "lang_pred string, recognised boolean", lambda texts: recognise_batch(model, texts))
