"""Secret scans: fixed patterns and a battery of randomness tests.

Base spans come from three patterns (assign, access, hex). Besides, every run of LEAST or more characters of the usual
encodings is a candidate, unless it holds digits alone. A run that no alphabet covers is split, at inner '=' and then both
at '/', '+' and at '-', '_', and each part of LEAST or more characters is a candidate, so that candidates of one run can
overlap. A candidate's encoding is inferred (the smallest alphabet that has all its characters), and three tests ask
whether its symbols could be drawn at random from that alphabet: chi-squared uniformity over its letters, Wald-Wolfowitz
runs above and below the middle, and lag-1 serial correlation. Fisher's method combines them into a randomness score, with
the first counting WEIGHT times. Scores are compared with those of names alone, so that no approximation is relied on.

What the scan looks for is the unusual: the null hypothesis of a candidate is that it is an ordinary name. How random
ordinary names look is estimated for each stratum, a class of length and an encoding, from names that are made of every document's
own words (one a length, in the styles of identifiers) and from NAMES built-in ones, so that small corpora have a null
distribution too; an encoding that fewer than FEW names have is held against all names of the length. A candidate's p-value
is the share of names that look as random as it does, and the Benjamini-Hochberg procedure over all candidates of the
stratum makes discoveries at false-discovery rate RATE. Discoveries are spans of kind `random`; short candidates, which
names are hard to tell from, need many fellows or find none.

The procedure needs only counts of scores by stratum and bin (STRATA * BINS numbers at most), summed in Spark.

Defined results: null and empty texts have no spans; null doc_ids and repeated rows are scanned like any other; texts of
any length are scanned whole; an empty table gives an empty result; other columns are ignored by scan and kept by redact,
whatever their names. Candidates that touch a base span are tested like others but not reported a second time.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octolith.llm.units import text_slices
from octolith.session import materialize

#: The base patterns and least lengths (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
#: A run of fewer than HEX_LEAST hex digits fails, and no other match begins within it.
HEX_FAST = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")
ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
KINDS = ("assign", "access", "hex", "random")
#: Least length of a candidate; lengths at which strata begin; share of false discoveries; bins of scores down to 2**-WIDEST.
EDGES, RATE, BINS, WIDEST = (16, 20, 24, 32, 40, 48, 64, 96, 128), 0.05, 512, 64.0
LEAST, NAMES, FEW, WEIGHT = EDGES[0], 4000, 200, 3
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
WORD = re.compile(r"[A-Za-z]{2,}")
#: Parts of a run between inner '=' (those at its end are padding), and parts of such a part that one alphabet covers.
BETWEEN, PARTS = re.compile(r"[^=]+(?:=+\Z)?"), (re.compile(r"[^/+]+"), re.compile(r"[^_-]+"))
LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets by size; a candidate's encoding is the first that has all its characters.
ALPHABETS = {
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "lower26": LOWER,
    "upper26": LOWER.upper(),
    "base32": LOWER.upper() + "234567",
    "upper36": DIGITS + LOWER.upper(),
    "lower36": DIGITS + LOWER,
    "alpha52": LOWER.upper() + LOWER,
    "base62": DIGITS + LOWER.upper() + LOWER,
    "base64": "+/" + DIGITS + LOWER.upper() + LOWER,
    "base64url": "-" + DIGITS + LOWER.upper() + "_" + LOWER,
}
STRATA = len(EDGES) * len(ALPHABETS)
#: Place of each byte in each alphabet, -1 for none.
PLACES = np.full((len(ALPHABETS), 256), -1, np.int64)
for _k, _letters in enumerate(ALPHABETS.values()):
    PLACES[_k, list(_letters.encode())] = np.arange(len(_letters))
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"
FOUND = "struct<start:bigint,end:bigint,encoding:string,p:double,stratum:int,bin:int,base:boolean>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end), ordered."""
    out = []
    if ASSIGN_HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX_FAST.finditer(text)]
    return sorted(out)


def normal_tail(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.array([math.erfc(x) for x in z / math.sqrt(2)])


def uniformity(v: np.ndarray, size: int) -> np.ndarray:
    """Chi-squared, by Wilson and Hilferty's approximation. v: a row of letters' places per token."""
    seen = np.bincount((np.arange(len(v))[:, None] * size + v).ravel(), minlength=len(v) * size).reshape(-1, size)
    wide, df = v.shape[1] / size, size - 1
    x = ((seen - wide) ** 2).sum(axis=1) / wide
    return normal_tail(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def runs(v: np.ndarray, size: int) -> np.ndarray:
    high, n = 2 * v >= size, v.shape[1]
    a = high.sum(axis=1)
    mean = 2 * a * (n - a) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    off = np.maximum(0.0, np.abs(1 + (high[:, 1:] != high[:, :-1]).sum(axis=1) - mean) - 0.5)
    p = 2 * normal_tail(off / np.sqrt(np.where(var > 0, var, 1.0)))
    return np.where(var > 0, np.minimum(p, 1.0), 2.0 ** (1 - n))  # no variance: all on one side


def serial(v: np.ndarray, size: int) -> np.ndarray:
    d = v - (size - 1) / 2
    r = (d[:, 1:] * d[:, :-1]).sum(axis=1) / ((size * size - 1) / 12)
    return 2 * normal_tail(np.abs(r) / math.sqrt(v.shape[1] - 1))


def fisher(ps: list[np.ndarray]) -> np.ndarray:
    """The tail of chi-squared with an even number of degrees of freedom is a finite sum."""
    half = np.minimum(700.0, -sum(np.log(np.maximum(p, 1e-300)) for p in ps))
    total = sum(half**k / math.factorial(k) for k in range(len(ps)))
    return np.minimum(1.0, total * np.exp(-half))


def encodings(tokens: np.ndarray) -> np.ndarray:
    """The first alphabet that has all characters of each row of bytes, -1 where none has."""
    out = np.full(len(tokens), -1)
    for k in reversed(range(len(PLACES))):
        out[(PLACES[k][tokens] >= 0).all(axis=1)] = k
    return out


def battery(tokens: list[str]) -> list[tuple[str, float] | None]:
    """(encoding, randomness score) of each token; padding is left out; None where no encoding has all characters."""
    bare = [t.rstrip("=").encode() for t in tokens]
    out: list = [None] * len(tokens)
    sizes = np.array([len(t) for t in bare])
    for n in np.unique(sizes[sizes > 1]).tolist():
        at = np.flatnonzero(sizes == n)
        rows = np.frombuffer(b"".join(bare[i] for i in at), np.uint8).reshape(-1, n)
        kind = encodings(rows)
        for k in np.unique(kind[kind >= 0]).tolist():
            own = np.flatnonzero(kind == k)
            name, size, v = list(ALPHABETS)[k], len(list(ALPHABETS.values())[k]), PLACES[k][rows[own]]
            p = fisher([uniformity(v, size) ** WEIGHT, runs(v, size), serial(v, size)])
            for i, x in zip(at[own].tolist(), p.tolist(), strict=True):
                out[i] = (name, x)
    return out


def infer(token: str) -> str | None:
    bare = token.rstrip("=").encode()
    k = int(encodings(np.frombuffer(bare, np.uint8).reshape(1, -1))[0])
    return None if k < 0 else list(ALPHABETS)[k]


def stratum(length: int, encoding: str) -> int:
    return (int(np.searchsorted(EDGES, length, side="right")) - 1) * len(ALPHABETS) + list(ALPHABETS).index(encoding)


def p_bin(p: float) -> int:
    """Bins of equal width in -log2 p, the least random first."""
    return int((BINS - 1) * (1 - min(WIDEST, -math.log2(max(p, 1e-300))) / WIDEST))


def covered(run: str) -> list[tuple[int, int]]:
    """(start, end) of what is tested of a run: all of it, or its parts where no alphabet covers it."""
    if infer(run) is not None:
        return [(0, len(run))]
    out = set()
    for m in BETWEEN.finditer(run):
        if infer(m.group()) is not None:
            out.add(m.span())
        else:
            out.update((m.start() + p.start(), m.start() + p.end()) for pattern in PARTS for p in pattern.finditer(m.group()))
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Tested runs of a text, ordered, and whether each touches a base span."""
    spots = [(m.start() + s, m.start() + e) for m in CANDIDATE.finditer(text) for s, e in covered(m.group())]
    spots = [(a, b) for a, b in sorted(spots) if len(bare := text[a:b].rstrip("=")) >= LEAST and not bare.isdigit()]
    out, at, reach = [], 0, -1  # reach: the furthest end of the base spans that begin before a candidate's end
    for (a, b), found in sorted(zip(spots, battery([text[a:b] for a, b in spots]), strict=True), key=lambda x: x[0][1]):
        while at < len(base) and base[at][0] < b:
            reach, at = max(reach, base[at][2]), at + 1
        if found:
            n = len(text[a:b].rstrip("="))
            out.append({"start": a, "end": b, "encoding": found[0], "p": found[1], "stratum": stratum(n, found[0]), "bin": p_bin(found[1]), "base": a < reach})
    return sorted(out, key=lambda c: (c["start"], c["end"]))


def make_name(words: list[str], start: int, length: int, style: int) -> str | None:
    """A name of so many characters from words that follow each other, in one of the styles of identifiers, cyclically."""
    between, camel, number = ("", "", "", "_", "-", "/")[style % 6], style % 6 in (1, 2), style // 6 % 3
    parts, n, k = [], 0, 0
    while n < length:
        w = words[(start + k) % len(words)].lower()
        w = w.capitalize() if camel and k else w
        parts.append(w)
        n, k = n + len(w) + len(between), k + 1
    name = between.join(parts)[: length - number * 2]
    name += str(style * 7919 + start)[-2 * number :].rjust(2 * number, "1") if number else ""
    return name.upper() if style // 18 % 4 == 0 else name


def name_codes(words: list[str], seed: int) -> list[str]:
    """One name for each stratum, from a place that the seed chooses; none where words are few."""
    if len(words) < 8:
        return []
    return [make_name(words, (seed + 31 * k) % len(words), n, seed // 7 + k) for k, n in enumerate(EDGES)]


def scored(names: list[str]) -> list[int]:
    """stratum * BINS + bin of names."""
    return [stratum(len(n), found[0]) * BINS + p_bin(found[1]) for n, found in zip(names, battery(names), strict=True) if found]


def built_in_names() -> dict[int, int]:
    """Counts of NAMES names a stratum, from the words of this module's description."""
    words, counts = WORD.findall(__doc__), {}
    for code in scored([x for k in range(NAMES) for x in name_codes(words, zlib.crc32(str(k).encode()))]):
        counts[code] = counts.get(code, 0) + 1
    return counts


def scan_rows(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), base spans, tested candidates, and scores of ordinary names, for every row."""
    span = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("kind", pa.string())])
    test = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("p", pa.float64()), ("stratum", pa.int32()), ("bin", pa.int32()), ("base", pa.bool_())])

    def run(batches):
        for batch in batches:
            rows = batch.column("row")
            for first, piece in text_slices(pc.struct_field(rows, "text").cast(pa.string())):
                base, found, made, owner = [], [], [], []
                for i, text in enumerate(piece.cast(pa.large_string()).to_pylist()):
                    spans = base_spans(text)
                    base.append([{"start": s, "rank": k, "end": e, "kind": KINDS[k]} for s, k, e in spans])
                    found.append(candidates(text, spans))
                    own = name_codes(WORD.findall(text), zlib.crc32(text.encode()))
                    made += own
                    owner += [i] * len(own)
                names = [[] for _ in base]
                for i, code in zip(owner, scored(made), strict=True):
                    names[i].append(code)
                yield pa.RecordBatch.from_arrays(
                    [rows.slice(first, len(piece)), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(test)), pa.array(names, pa.list_(pa.int32()))],
                    names=["row", "base", "candidates", "names"],
                )

    fields = T.StructType([T.StructField("row", T.StructType(docs.schema.fields))])
    more = T._parse_datatype_string(f"base array<{SPAN}>, candidates array<{FOUND}>, names array<int>")
    return docs.select(F.struct("*").alias("row")).mapInArrow(run, T.StructType([*fields.fields, *more.fields]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base spans, tested candidates and scores of ordinary names of every row."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scan_rows(slim).select("row.doc_id", "base", "candidates", "names")


def thresholds(scanned: DataFrame, rate: float = RATE) -> dict[int, int]:
    """Per stratum the first bin that is a discovery (BINS: none is)."""
    tested = scanned.select(F.explode("candidates").alias("c")).select((F.col("c.stratum") * BINS + F.col("c.bin")).alias("code"), F.lit(True).alias("tested"))
    names = scanned.select(F.explode("names").alias("code"), F.lit(False).alias("tested"))
    counts = tested.unionByName(names).groupBy("code", "tested").count().collect()  # STRATA * BINS * 2 rows at most
    seen, null = np.zeros((STRATA, BINS), np.int64), np.zeros((STRATA, BINS), np.int64)
    for code, n in built_in_names().items():
        null[divmod(code, BINS)] += n
    for r in counts:
        (seen if r["tested"] else null)[divmod(r["code"], BINS)] += r["count"]
    upto = lambda x: x[:, ::-1].cumsum(axis=1)[:, ::-1]  # noqa: E731  # so many in this bin and beyond
    every = np.repeat(null.reshape(len(EDGES), -1, BINS).sum(axis=1), len(ALPHABETS), axis=0)
    null = np.where(null.sum(axis=1, keepdims=True) < FEW, every, null)
    p = (1 + upto(null)) / (1 + null.sum(axis=1, keepdims=True))
    found = (seen > 0) & (p <= rate * upto(seen) / np.maximum(1, seen.sum(axis=1, keepdims=True)))
    return {k: int(np.argmax(found[k])) if found[k].any() else BINS for k in range(STRATA)}


def _random(limits: dict[int, int]) -> Column:
    limit = F.array(*[F.lit(limits[k]) for k in range(STRATA)])
    kept = F.filter("candidates", lambda c: (c["bin"] >= F.get(limit, c["stratum"])) & ~c["base"])
    return F.transform(kept, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("rank"), c["end"].alias("end"), F.lit("random").alias("kind")))


def with_spans(scanned: DataFrame, limits: dict[int, int]) -> DataFrame:
    """scanned with spans: base and random ones, ordered by start and kind."""
    return scanned.withColumn("spans", F.array_sort(F.concat("base", _random(limits))))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All rows with all columns; in text every span is replaced by the mark, and n_chars, if there, counts anew.

    Texts are scanned once; what was found is written with them.
    """
    scanned = materialize(scan_rows(docs), "scanned")
    found = with_spans(scanned, thresholds(scanned)).select("row", F.transform("spans", lambda s: s["start"]).alias("starts"), F.transform("spans", lambda s: s["end"]).alias("ends"))
    schema = docs.schema

    def clean(text, starts, ends):
        if not starts:
            return text
        out, at = [], 0
        for s, e in sorted(zip(starts, ends, strict=True)):
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join([*out, text[at:]])

    def run(batches):
        for batch in batches:
            row = batch.column("row")
            columns = {f.name: pc.struct_field(row, f.name) for f in row.type}
            texts = [clean(*x) for x in zip(columns["text"].to_pylist(), batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)]
            columns["text"] = pa.array(texts, columns["text"].type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return found.mapInArrow(run, schema)


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents."""
    scanned = materialize(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")), "secrets")
    found = with_spans(scanned, thresholds(scanned))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
