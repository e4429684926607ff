"""Secret scan: a randomness test battery over encoded strings, with length-aware false-discovery control.

A candidate is a run of at least ``min_length`` letters, digits and ``+/_-`` of a text. Its encoding is the
least alphabet that holds it, and it has room for ``min_bits`` bits in that; a number of sixteen digits has not. Three tests ask whether its symbols could be random:

* chi-squared uniformity over equal ranges of the alphabet, as many as the length allows five symbols each;
* runs above and below the middle of the alphabet (Wald and Wolfowitz);
* serial correlation of neighbouring symbols.

Fisher's method combines their p-values into a score: a secret's is anything from 0 to 1, that of ordinary text is near 0. How far ordinary
strings get by chance is measured, not assumed: decoys are strings of as many symbols of the same alphabet from the
ordinary text of a candidate's own document, up to ``DECOYS`` of them, and a few from a text in this module. A candidate's p-value is its rank
among the decoys of its stratum, that is its encoding and length: (1 + decoys that score as high) / (1 + decoys). A stratum with
fewer than ``THIN`` decoys also takes those of shorter strings, which score higher. Benjamini and Hochberg's procedure over the candidates of a stratum, with Storey's estimate of
the share of ordinary ones from the p-values above a half, gives q-values, and findings have ``q <= rate``; so a string can't vouch for itself, and few decoys can't vouch for much. Decoys don't know strings of symbols that
ordinary text hasn't got, so the battery itself must not reject a finding at ``FLOOR``. The strata are a fixed number of counters.

Defined cases: null and empty texts have no candidates; repeated rows are scanned each, null ids stay null;
ties share a q-value (scores are compared in ``BINS`` steps); a document without enough ordinary text gives
no decoys; empty tables give no rows; extra columns are ignored. A finding has no part of the string itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import written

MIN_LENGTH = 16
MIN_BITS = 64
BINS = 1000
DECOYS = 16
THIN = 50
FLOOR = 0.001
_B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: From the least alphabet on; a string has the first that holds all its symbols.
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "letters": "abcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": _B64,
    "base64url": _B64[:-2] + "-_",
    "mixed": _B64 + "-_",
}
NAMES = list(ALPHABETS)
SIZES = np.array([len(a) for a in ALPHABETS.values()])
VALUES = np.full((len(NAMES), 256), -1, np.int64)
for _i, _a in enumerate(ALPHABETS.values()):
    VALUES[_i, [ord(c) for c in _a]] = np.arange(len(_a))
_CANDIDATE = VALUES[-1] >= 0
_LENGTHS = np.array([20, 24, 28, 36, 48, 64, 96, 160])
#: Ordinary text with words, names and numbers; the decoys of a corpus that hasn't any.
REFERENCE = """
The first release was announced in March 2019 and the second in October 2021; version 3 followed on 12 January 2024. Please read the
documentation before you open /usr/local/share/applications/settings or change /etc/default/network/interfaces.d by hand. The function
get_user_profile_by_name calls readConfigurationFromFile and then writeResultsToDatabase, while MAX_NUMBER_OF_CONNECTIONS and
DEFAULT_REQUEST_TIMEOUT_SECONDS are constants. Chapter 10, pages 100 to 150, and table 200 of the annual report for 2018 list 1000
customers, 2500 orders and 30000 items in stock; the total came to 1250000 and the average to 1999. Invoices 2020001, 2020002 and
2020003 were paid on 2020-05-15, 2020-06-15 and 2020-07-30. Our offices at 120 Market Street are open from 0900 to 1730, and the number is
555 0100 or 555 0123. THE QUICK BROWN FOX JUMPED OVER THE LAZY DOG BECAUSE THE TERMS AND CONDITIONS OF THIS AGREEMENT SHALL BE GOVERNED BY
THE LAW OF THE PLACE WHERE IT WAS MADE. A faded facade, a bad cafe, dead beef and decaf: add bed 200, cab 300, fee 400, ace 500, face 800, bead 1000.
DEAD BEEF AND DECAF, A FADED FACADE: ADD BED 200, CAB 300, FEE 400, ACE 500, FACE 800. Quarterly-Revenue-Report-2023-Final-Version and
annual-results-summary-2022-draft are kept in src/main/java/com/example/service/impl/UserAccountServiceImplementation with
test_that_the_parser_returns_an_empty_list and http_server_error_handler. ABCDEFGHIJKLMNOPQRSTUVWXYZ and 0123456789 are in order.
"""
_erfc = np.frompyfunc(math.erfc, 1, 1)


def _chi2_tail(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Upper tail of chi-squared, by Wilson and Hilferty's cube root."""
    z = (np.cbrt(x / df) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df))
    return np.clip(0.5 * _erfc(z / math.sqrt(2)).astype(float), 1e-300, 1)


def battery(v: np.ndarray, offs: np.ndarray, m: np.ndarray) -> np.ndarray:
    """p-values of (uniformity, runs, serial correlation, all) for strings of symbols ``v[offs[i]:offs[i+1]]`` below ``m[i]``."""
    n = np.diff(offs)
    row = np.repeat(np.arange(len(n)), n)
    m_ = m[row]
    k = np.clip(n // 5, 2, m)
    # Values of range j of k in an alphabet of m: those with v * k // m == j.
    width = int(k.max(initial=2))
    seen = np.bincount(row * width + v * k[row] // m_, minlength=len(n) * width).reshape(-1, width)
    edge = -(-np.arange(width + 1)[None, :] * m[:, None] // k[:, None])
    expected = n[:, None] * np.diff(np.minimum(edge, m[:, None]), axis=1) / m[:, None]
    chi2 = np.where(expected > 0, (seen - expected) ** 2 / np.where(expected > 0, expected, 1), 0).sum(1)
    uniform = _chi2_tail(chi2, k - 1)

    high = v >= (m_ + 1) // 2
    n1 = np.bincount(row, high, len(n))
    n2 = n - n1
    inner = np.flatnonzero(row[1:] == row[:-1])
    r = 1 + np.bincount(row[inner], high[inner] != high[inner + 1], len(n))
    mean = 2 * n1 * n2 / n + 1
    var = np.maximum((mean - 1) * (mean - 2) / np.maximum(n - 1, 1), 1e-9)
    runs = np.where((n1 == 0) | (n2 == 0), 1e-12, np.clip(_erfc(np.abs(r - mean) / np.sqrt(2 * var)).astype(float), 1e-300, 1))

    c = v - (m_ - 1) / 2
    var = (m.astype(float) ** 2 - 1) / 12
    z = np.bincount(row[inner], c[inner] * c[inner + 1], len(n)) / (var * np.sqrt(np.maximum(n - 1, 1)))
    serial = np.clip(_erfc(np.abs(z) / math.sqrt(2)).astype(float), 1e-300, 1)
    p = np.stack((uniform, runs, serial), 1)
    fisher = -np.log(p).sum(1)  # half of Fisher's statistic; its tail with 6 degrees of freedom is closed
    return np.column_stack((p, np.exp(-fisher) * (1 + fisher + fisher**2 / 2)))


def _decoys(ordinary: bytes, offset: int, n: int, most: int = DECOYS) -> list[bytes]:
    """Strings of ``n`` symbols of the ordinary text, side by side from an offset on, around its end."""
    count = min(most, len(ordinary) // n)
    starts = [(offset * 2654435761 + i * (len(ordinary) // max(1, count))) % len(ordinary) for i in range(count)]
    return [(ordinary[i : i + n] + ordinary[: max(0, i + n - len(ordinary))]) for i in starts]


def _symbols(text: bytes | np.ndarray, kind: int) -> bytes:
    text = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    return text[VALUES[kind][text] >= 0].tobytes()


def _scores(strings: list[bytes], kinds: np.ndarray) -> np.ndarray:
    """The battery's last p-value of each string of symbols."""
    n = np.array([len(x) for x in strings], np.int64)
    return battery(VALUES[np.repeat(kinds, n), np.frombuffer(b"".join(strings), np.uint8)], np.concatenate(([0], np.cumsum(n))), SIZES[kinds])[:, 3] if len(n) else np.zeros(0)


def stratum_of(length: np.ndarray | int) -> np.ndarray:
    return np.searchsorted(_LENGTHS, length, "right")


def reference_decoys(min_length: int) -> dict[tuple[int, int], np.ndarray]:
    """Scores of the decoys of this module's text by (encoding, stratum), each as long as the stratum's shortest strings."""
    out = {}
    for kind in range(len(NAMES)):
        text = _symbols(REFERENCE.encode(), kind)
        for stratum, n in enumerate((min_length, *_LENGTHS.tolist())):
            starts = range(0, len(text) - n + 1, max(1, (len(text) - n) // 64))
            strings = [text[i : i + n] for i in starts]
            out[kind, stratum] = _scores(strings, np.full(len(strings), kind))
    return out


def _block(data: np.ndarray, offs: np.ndarray, min_length: int, min_bits: float) -> dict[str, np.ndarray] | None:
    start, end, row = _text.spans(data, offs, _CANDIDATE)
    keep = end - start >= min_length
    if not keep.any():
        return None
    start, end, row = start[keep], end[keep], row[keep]
    n = end - start
    tokens = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat(start - tokens[:-1], n) + np.arange(tokens[-1])
    symbols = data[at]
    fits = np.stack([np.logical_and.reduceat(VALUES[i][symbols] >= 0, tokens[:-1]) for i in range(len(NAMES))])
    kind = fits.argmax(0)
    inside = np.zeros(len(data), bool)
    inside[at] = True
    wide = n * np.log2(SIZES[kind]) >= min_bits
    if not wide.any():
        return None
    symbols, start, row, kind, n = symbols[np.repeat(wide, n)], start[wide], row[wide], kind[wide], n[wide]
    own = battery(VALUES[np.repeat(kind, n), symbols], np.concatenate(([0], np.cumsum(n))), SIZES[kind])
    decoys: list[bytes] = []
    sizes = []
    ordinary: dict[tuple[int, int], bytes] = {}
    for r, k, at_, length in zip(row.tolist(), kind.tolist(), (start - offs[row]).tolist(), n.tolist()):
        if (r, k) not in ordinary:
            ordinary = {x: t for x, t in ordinary.items() if x[0] == r}
            ordinary[r, k] = _symbols(data[offs[r] : offs[r + 1]][~inside[offs[r] : offs[r + 1]]], k)
        found = _decoys(ordinary[r, k], at_, length)
        decoys += found
        sizes.append(len(found))
    scores = _scores(decoys, np.repeat(kind, sizes))
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return {"row": row, "start": chars[start] - chars[offs[row]], "length": n, "kind": kind, "own": own, "decoys": scores, "sizes": np.array(sizes)}


_COLUMNS = "doc_id long, start long, length long, encoding string, p_uniform double, p_runs double, p_serial double, p_random double"


def candidates(docs: DataFrame, min_length: int = MIN_LENGTH, min_bits: float = MIN_BITS) -> DataFrame:
    """(doc_id, start, length, encoding, p_uniform, p_runs, p_serial, p_random, p_decoys) of every candidate; start counts characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(NAMES)
        for b in batches:
            for first, data, offs in _text.blocks(b.column("text")):
                x = _block(data, offs, min_length, min_bits)
                if x:
                    own = [pa.array(x["own"][:, i]) for i in range(4)]
                    decoys = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(x["sizes"]))).astype(np.int32)), pa.array(x["decoys"]))
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(first + x["row"])), pa.array(x["start"]), pa.array(x["length"]), names.take(pa.array(x["kind"])), *own, decoys], [*(c.split()[0] for c in _COLUMNS.split(", ")), "p_decoys"])

    return docs.select("doc_id", "text").mapInArrow(run, f"{_COLUMNS}, p_decoys array<double>")


def _q_values(own: np.ndarray, decoys: np.ndarray) -> np.ndarray:
    """For each bin the least rate of any threshold that lets it in, from how many candidates and decoys each bin has."""
    p = (1 + np.cumsum(decoys[::-1])[::-1]) / (1 + decoys.sum())
    ordinary = min(own.sum(), 2 * (1 + own[p > 0.5].sum()))
    rate = p * ordinary / np.maximum(np.cumsum(own[::-1])[::-1], 1)
    return np.minimum(1, np.minimum.accumulate(rate))


def secrets(docs: DataFrame, rate: float = 0.05, min_length: int = MIN_LENGTH, min_bits: float = MIN_BITS) -> DataFrame:
    """(doc_id, start, length, encoding, p_uniform, p_runs, p_serial, p_random, q_value) of the candidates that pass."""
    stratum = F.lit(0)
    for edge in _LENGTHS.tolist():
        stratum = stratum + (F.col("length") >= edge).cast("int")

    def bin_of(p: Column) -> Column:
        return F.floor(p * (BINS - 1)).cast("int")

    found = written(candidates(docs, min_length, min_bits).withColumn("stratum", stratum).withColumn("bin", bin_of(F.col("p_random"))), "secret-candidates")
    # At most as many counters as there are encodings, lengths and bins, whatever the number of documents.
    both = found.select("encoding", "stratum", F.explode(F.concat(F.array(F.struct("bin", F.lit(1).alias("own"))), F.transform("p_decoys", lambda x: F.struct(bin_of(x).alias("bin"), F.lit(0).alias("own"))))).alias("x"))
    tally = both.groupBy("encoding", "stratum", "x.bin").agg(F.sum("x.own").alias("own"), F.count("*").alias("n")).collect()
    strata = len(_LENGTHS) + 1
    own, decoys = np.zeros((len(NAMES), strata, BINS)), np.zeros((len(NAMES), strata, BINS))
    for r in tally:
        own[NAMES.index(r.encoding), r.stratum, r.bin] += r.own
        decoys[NAMES.index(r.encoding), r.stratum, r.bin] += r.n - r.own
    for (k, s), p in reference_decoys(min_length).items():
        np.add.at(decoys[k, s], np.floor(p * (BINS - 1)).astype(int), 1)
    rows = []
    for k, s in zip(*np.nonzero(own.sum(2))):
        pool = decoys[k, s] if decoys[k, s].sum() >= THIN else decoys[k, : s + 1].sum(0)
        q = _q_values(own[k, s], pool)
        rows += [(NAMES[k], int(s), int(i), float(q[i])) for i in np.flatnonzero(own[k, s])]
    q = docs.sparkSession.createDataFrame(rows, "encoding string, stratum int, bin int, q_value double")
    joined = found.join(F.broadcast(q), ["encoding", "stratum", "bin"])
    return joined.where((F.col("q_value") <= rate) & (F.col("p_random") >= FLOOR)).select("doc_id", "start", "length", "encoding", "p_uniform", "p_runs", "p_serial", "p_random", "q_value")
