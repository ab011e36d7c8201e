"""Fill-in-the-middle: texts cut at two ranks of their units and put in another order around sentinels.

A unit is a word with the white space before it; white space at the end is a unit of its own.  One Aho-Corasick
automaton finds the ASCII characters that end a word and the sentinels in a single scan.  Those events are sparse: a
gap between two neighbouring ends of words holds exactly one unit, so units are counted and looked up by rank with
arithmetic on event positions, and no unit is ever materialised.  Cuts are the only thing tasks return; texts are
put together by built-in functions.
"""

from __future__ import annotations

from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_prefix, own_columns, quoted, table

# The sentinels before prefix, suffix and middle, and the six white-space characters.
SENTINELS = ("<P>", "<S>", "<M>")
BREAKS = " \t\n\x0b\x0c\r"
#: Shares in percent of texts that are rearranged, and of those that begin with the suffix; the seed of the draws.
RATE, SPM, SEED = 50, 80, 42
CUTS = "n long, marked boolean, first long, second long"


@cache
def automaton(sentinels: tuple[str, ...]):
    """Finds breaks (0) and sentinels (1); one for each worker process."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in BREAKS:
        found.add_word(word, 0)
    for word in sentinels:
        found.add_word(word, 1)
    found.make_automaton()
    return found


def unit_ends(text: str, sentinels: tuple[str, ...] = SENTINELS) -> tuple[np.ndarray, bool]:
    """Where each unit ends, in code points, and whether the text holds a sentinel."""
    events = np.fromiter(chain.from_iterable(automaton(sentinels).iter(text)), np.int64).reshape(-1, 2)
    breaks = events[events[:, 1] == 0, 0]
    edges = np.append(breaks, len(text))
    ends = edges[np.diff(edges, prepend=-1) > 1]  # a word lies in the gap before such a break
    if len(breaks) and breaks[-1] == len(text) - 1:
        ends = np.append(ends, len(text))
    return ends, len(breaks) < len(events)


def cuts(text: Column, a: Column, b: Column, sentinels: tuple[str, ...] = SENTINELS) -> Column:
    """(n, marked, first, second): units, whether a sentinel occurs, and where the smaller and the larger of a % (n + 1) and b % (n + 1) units end."""

    @F.arrow_udf(CUTS)
    def run(texts: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        rows = []
        for x, i, j in zip(texts, a.to_pylist(), b.to_pylist(), strict=True):
            ends, marked = unit_ends(x.as_py() or "", sentinels)
            n = len(ends)
            at = np.append(0, ends)[sorted((i % (n + 1), j % (n + 1)))]
            rows.append((n, marked, int(at[0]), int(at[1])))
        n, marked, first, second = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(marked, pa.bool_()), pa.array(first, pa.int64()), pa.array(second, pa.int64())], ["n", "marked", "first", "second"])

    return run(text, a, b)


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED, sentinels: tuple[str, ...] = SENTINELS, key: str = "doc_id") -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars and output.

    Draws are the first four 8-digit groups of the sha256 of seed:key, so reruns agree and equal keys are drawn alike.
    form is plain (the text itself), psm (prefix, suffix, middle) or spm (suffix, prefix, middle).  Null texts count as
    empty; empty texts and texts that hold a sentinel stay plain; a null key is drawn as an empty one.  Texts of any
    length are scanned whole.  Columns of docs with the names of the added ones are replaced, others are kept whatever
    their names.  An empty table gives an empty result.
    """
    added = ("n", "form", "prefix_chars", "middle_chars", "output")
    docs = docs.drop(*added)
    p = free_prefix(docs)
    names = own_columns(docs)
    draws = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(quoted(key)).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(draws, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    rows = docs.select(*names, F.coalesce("text", F.lit("")).alias(f"{p}text"), *[x.alias(f"{p}h{k}") for k, x in enumerate(h)])
    rows = rows.withColumn(f"{p}cut", cuts(F.col(f"{p}text"), F.col(f"{p}h0"), F.col(f"{p}h1"), sentinels))
    text, first, second = F.col(f"{p}text"), F.col(f"{p}cut.first").cast("int"), F.col(f"{p}cut.second").cast("int")
    plain = (text == "") | F.col(f"{p}cut.marked") | (F.col(f"{p}h2") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col(f"{p}h3") % 100 < spm, "spm").otherwise("psm")
    prefix, middle = F.substring(text, F.lit(1), first), F.substring(text, first + 1, second - first)
    suffix = F.substring(text, second + 1, F.length(text))
    mark = dict(zip("PSM", map(F.lit, sentinels), strict=True))
    psm = F.concat(mark["P"], prefix, mark["S"], suffix, mark["M"], middle)
    output = F.when(plain, text).when(F.col(f"{p}h3") % 100 < spm, F.concat(mark["S"], suffix, mark["P"], prefix, mark["M"], middle)).otherwise(psm)
    own = [F.when(~plain, x) for x in (F.col(f"{p}cut.first"), F.col(f"{p}cut.second") - F.col(f"{p}cut.first"))]
    return rows.select(*names, F.col(f"{p}cut.n").alias("n"), form.alias("form"), own[0].alias("prefix_chars"), own[1].alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, ...] = SENTINELS) -> Column:
    """The text that an output of this form was made of; null for null.  Sentinels occur once each there, as texts that hold one stay plain."""
    parts = F.split(output, "|".join(f"\\Q{x}\\E" for x in sentinels), -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def op12_fill_in_middle(spark, sf_dir):
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda x: F.sha2(x, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::varchar, '')) AS h FROM documents),
h AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
             ('0x' || h[1:8])::bigint AS h1, ('0x' || h[9:16])::bigint AS h2, ('0x' || h[17:24])::bigint AS h3, ('0x' || h[25:32])::bigint AS h4 FROM d),
c AS (SELECT *, len(units)::bigint AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::bigint AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::bigint AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""
