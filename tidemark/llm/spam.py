"""Keyword-stuffed and link-list pages (problem 9).

1. Every document is read once, whole, for list-density evidence (links to other sites, different sites, words around
   each link; words in lines that aren't code or data, how few different ones, how many in lines without a sentence end)
   and for its phrase shingles: five words of one list item or part of a sentence, in any order, an item of two to four
   words as it is, and every linked site.
2. The phrases of all documents are exploded, and the distinct hosts (repositories) of each are counted in two steps, so that
   a phrase of a third of all documents is no single task's.
3. A page with any list density is spam if it is stitched mostly (``STITCHED``) from list phrases: phrases that stand on
   list pages of ``HOSTS`` hosts or more that aren't copies of one file (under most of three orders of phrases, these pages
   have ``HOSTS`` different least phrases), and on no more hosts outside list pages than on them (stock comments and
   licences are replicated too, but mostly in ordinary files).
4. A page of phrases that no three hosts share (a site's own subject repeated over and over, a list of links to sites
   that nobody else links to) is spam by its density alone if that is strong and there is enough of it to tell:
   ``SITES`` sites with few words around them, or ``ENOUGH`` words of which each stands at least ``USES`` times on average.
A page without any list density isn't judged, but its phrases count for those of the pages that are.

Results for odd input: null, empty and blank texts aren't spam; a null host counts as a host of its own; repeated doc_ids are
each judged; an empty table gives an empty table; very long texts are read whole, in linear time and bounded pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import cut, sized_join
from tidemark.llm.phrases import ORDERS, families, name_hash, scan

#: Hosts on which a phrase must stand to count as replicated.
HOSTS = 3
#: Share of a page's phrases from which it is stitched.
STITCHED = 0.5
#: List density of any kind: links, words per link; words, share of the text in plain lines, and either few different words
#: (over the root of all words) or a share of words in lines without a sentence end.
LINKS, PER_LINK, WORDS, PLAIN, VARIETY, LOOSE = 4, 14, 12, 0.55, 4.2, 0.8
#: Strong density: sites, words per link; words, uses of each, share of the text in plain lines, different words over the root.
SITES, STRONG_PER_LINK, ENOUGH, USES, STRONG_PLAIN, STRONG_VARIETY = 8, 10, 25, 2.0, 0.75, 3.5
#: Characters of texts handled at once.
BATCH_CHARS = 4_000_000

_LINK = re.compile(r"//(?:www\.)?([\w-]+(?:\.[\w-]+)+)[^\s<>()\[\]\"']*")
_TAG = re.compile(r"<(?!https?:|//)[a-zA-Z/!][^<>]*>|\[/?(?:url|img|b|i)(?:=[^\]\s]*)?\]")
_META = re.compile(r"<meta\s+name=[\"']keywords[\"']\s+content=[\"']([^\"']*)[\"'][^>]*>", re.I)
_KEYS = re.compile(r"\"(?:keywords|tags)\"\s*:\s*\[([^\]]*)\]", re.I)
_HASHTAG = re.compile(r"#\w+")
_CAMEL = re.compile(r"(?<=[^\W\d_A-Z])(?=[A-Z])|(?<=[0-9])(?=[A-Z])")


def _linked(text: str) -> tuple[str, list[str]]:
    """The text with tabs for its links, and the sites they lead to. A link in quotes is data, unless it is an anchor's."""
    sites, rest, at = [], [], 0
    for m in _LINK.finditer(text):
        start = m.start()
        if text.endswith("https:", 0, start):
            start -= 6
        elif text.endswith("http:", 0, start):
            start -= 5
        before = text[max(0, start - 7) : start]
        if before.lower().rstrip("\"' ").endswith(("href=", "[url=")):
            sites.append(m.group(1).lower())  # the tag around it goes later
        elif not (before and (before[-1] in "\"':_" or before[-1].isalnum())):
            sites.append(m.group(1).lower())
            rest.append(text[at:start])
            at = m.end()
    return ("\t".join([*rest, text[at:]]) if at else text), sites


def tidy(text: str) -> tuple[str, list[str]]:
    """The lower-case text without links and tags (keywords of meta tags and JSON lists stay), and the linked sites."""
    sites: list[str] = []
    if '"keywords"' in text or '"tags"' in text:
        text = _KEYS.sub(lambda m: "\n" + m.group(1).replace('"', " ") + "\n", text)
    if "//" in text:
        text, sites = _linked(text)
    if "<" in text or "[" in text:
        if "<meta" in text:
            text = _META.sub("\t\\1\t", text)
        text = _TAG.sub("\t", text)
    if "#" in text:
        text = _HASHTAG.sub(lambda m: _CAMEL.sub(" ", m.group()), text)
    return text.lower(), sites


_KINDS = (("links", pa.int32()), ("sites", pa.int32()), ("all_words", pa.int64()), ("words", pa.int64()), ("variety", pa.float64()), ("plain", pa.float64()), ("loose", pa.float64()))


def evidence(texts: list[str]) -> dict[str, np.ndarray]:
    """links, sites, all_words, words (in plain lines), variety (different words over the root of all), plain and loose
    (shares of the text), phrases (``upto``: the places where each text's begin), families, listed."""
    tidied = [tidy(t) for t in texts]
    s = scan([t for t, _ in tidied], [[name_hash(x) for x in set(sites)] for _, sites in tidied])
    out = {
        "links": np.array([len(x) for _, x in tidied], np.int64),
        "sites": np.array([len(set(x)) for _, x in tidied], np.int64),
        "all_words": s.all_words,
        "words": s.words,
        "variety": s.distinct / np.sqrt(np.maximum(s.words, 1)),
        "plain": s.plain / np.maximum(s.total, 1),
        "loose": s.loose / np.maximum(s.words, 1),
        "phrases": s.phrases,
        "upto": s.upto,
        "families": families(s.phrases, s.upto),
    }
    by_links = (out["links"] >= LINKS) & (out["all_words"] < PER_LINK * out["links"])
    by_words = (out["words"] >= WORDS) & (out["plain"] >= PLAIN) & ((out["variety"] < VARIETY) | (out["loose"] >= LOOSE))
    return out | {"listed": by_links | by_words}


def _pages(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """Every document with a text: key, host, evidence, phrase shingles, and whether it looks like a list at all (``listed``)."""
    kind = dict(docs.dtypes)[key]
    names = [key, "host", *[n for n, _ in _KINDS], "shingles", "families", "listed"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch.column(3).fill_null(0))
            group = np.cumsum(size) // BATCH_CHARS
            edges = np.concatenate([[0], np.nonzero(np.diff(group))[0] + 1, [batch.num_rows]])
            for a, b in zip(edges[:-1], edges[1:]):
                part = batch.slice(a, b - a)
                part = part.filter(pa.array(size[a:b] > 0))
                if part.num_rows:
                    got = evidence(part.column(0).to_pylist())
                    lists = pa.ListArray.from_arrays(pa.array(got["upto"], pa.int32()), pa.array(got["phrases"], pa.int64()))
                    fixed = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * len(ORDERS), pa.int32()), pa.array(got["families"].ravel(), pa.int64()))
                    yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), *[pa.array(got[n]).cast(k) for n, k in _KINDS], lists, fixed, pa.array(got["listed"])], names=names)

    whole = docs.select(F.col(text).alias("_text"), key, F.coalesce(F.col(host), F.concat(F.lit("\0"), F.col(key).cast("string"))).alias("host"), F.length(F.col(text)).alias("_size"))
    return whole.mapInArrow(read, f"`{key}` {kind}, host string, links int, sites int, all_words bigint, words bigint, variety double, plain double, loose double, shingles array<bigint>, families array<bigint>, listed boolean")


def list_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "repo") -> DataFrame:
    """The pages that look like a list at all: key, host, evidence and phrase shingles."""
    return _pages(docs, key, text, host).filter("listed").drop("families", "listed")


def spam_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "repo") -> DataFrame:
    """One row per list page with its evidence, ``replicated`` (share of its phrases on ``HOSTS`` hosts or more), ``stitched``
    (share of its phrases that are list phrases), ``reason`` (phrases, links, keywords) and ``spam``."""
    every = cut(_pages(docs, key, text, host).withColumn("_page", F.monotonically_increasing_id()))
    pages = every.filter("listed")
    spread = every.select(F.xxhash64("host").alias("host"), "listed", F.explode("shingles").alias("shingle"))
    spread = spread.groupBy("shingle", "host").agg(F.max("listed").alias("listed"))
    spread = spread.groupBy("shingle").agg(F.count(F.lit(1)).alias("hosts"), F.count_if("listed").alias("list_hosts")).filter((F.col("hosts") >= HOSTS) & (F.col("list_hosts") > 0))
    phrases = pages.select("_page", *[F.col("families")[o].alias(f"family{o}") for o in range(len(ORDERS))], F.explode("shingles").alias("shingle"))
    least = phrases.groupBy("shingle").agg(*[F.count_distinct(f"family{o}").alias(f"n{o}") for o in range(len(ORDERS))])
    apart = F.array_sort(F.array(*[F.col(f"n{o}") for o in range(len(ORDERS))]))[len(ORDERS) // 2]
    stock = spread.join(least, "shingle").select("shingle", ((F.col("list_hosts") >= HOSTS) & (apart >= HOSTS) & (F.col("list_hosts") * 2 >= F.col("hosts"))).alias("list_phrase"))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias
    shares = sized_join(phrases.select("_page", "shingle"), stock, ["shingle"]).groupBy("_page").agg(share(F.col("list_phrase").isNotNull())("replicated"), share(F.col("list_phrase"))("stitched"))
    pages = pages.drop("shingles", "families", "listed").join(shares, "_page", "left").drop("_page").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("replicated", "stitched")})
    stitched = F.col("stitched") >= STITCHED
    bare = (F.col("sites") >= SITES) & (F.col("sites") * 2 >= F.col("links")) & (F.col("all_words") < STRONG_PER_LINK * F.col("links"))
    often = F.col("variety") * USES <= F.sqrt(F.col("words"))
    stuffed = (F.col("words") >= ENOUGH) & often & (F.col("variety") < STRONG_VARIETY) & (F.col("plain") >= STRONG_PLAIN)
    reason = F.when(stitched, "phrases").when(bare, "links").when(stuffed, "keywords")
    return pages.withColumn("reason", reason).withColumn("spam", F.col("reason").isNotNull())
