"""Main text of HTML pages by differencing pages with the nearest URLs (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ordered_index, staged
from .html_blocks import Block, blocks

#: Neighbouring pages that are aligned in one group.
CHUNK = 128
#: Pages that share at least this part of the smaller one's text are copies, which show no template; the next page but so many is then taken.
COPY_SHARE, NEAR = 0.5, 8
#: Blocks with more of their text in links are menus, where the markup marks no article.
LINK_SHARE = 0.66
#: Up to so many pages with deleted lines are sent to every executor; beyond it, the join shuffles.
BROADCAST_PAGES = 50_000


def lcs(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence, by bit rows of which every k-th is kept."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    common = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    ai = [i for i in range(head, len(a) - tail) if a[i] in common]
    bi = [i for i in range(head, len(b) - tail) if b[i] in common]
    middle = []
    if ai and bi:
        match: dict[int, int] = {}
        for j, i in enumerate(bi):
            match[b[i]] = match.get(b[i], 0) | 1 << j
        full = (1 << len(bi)) - 1
        every = max(1, int(len(ai) ** 0.5))

        def rows(first: int, row: int) -> list[int]:
            out = [row]
            for i in ai[first : first + every]:
                both = out[-1] & match[a[i]]
                out.append((out[-1] + both | out[-1] - both) & full)
            return out

        kept = [full]
        for first in range(0, len(ai), every):
            kept.append(rows(first, kept[-1])[-1])
        # bit j of a row is 0 where the LCS grows by b's element j
        j = len(bi)
        for block in range(len(kept) - 2, -1, -1):
            own = rows(block * every, kept[block])
            for k in range(len(own) - 2, -1, -1):
                i = block * every + k
                while j:
                    grows_here = not own[k + 1] >> (j - 1) & 1
                    if not grows_here:
                        j -= 1
                    elif not own[k] >> (j - 1) & 1:
                        break  # the LCS up to here doesn't need a's element i
                    else:
                        middle.append((ai[i], bi[j - 1]))
                        j -= 1
                        break
    tails = [(len(a) - 1 - t, len(b) - 1 - t) for t in range(tail)]
    return sorted([(i, i) for i in range(head)] + middle + tails)


def chosen(found: list[Block], shared: set[int]) -> list[str]:
    """The article's blocks: where nothing is marked, all that aren't shared with other pages, marked as something else or menus.

    Of a marked article without the parts marked as something else, shared menus go; its other lines stay although they
    are shared, as articles quote each other and repeat lines of their own.
    """
    own = [(b, i in shared) for i, b in enumerate(found) if not b.outside]
    if any(b.contained for b, _ in own):
        return [b.text for b, again in own if b.contained and not (again and b.link_share > LINK_SHARE)]
    return [b.text for b, again in own if not again and b.link_share <= LINK_SHARE]


def outlines(pages: DataFrame) -> DataFrame:
    """key, host, path, and of each block the hash and the length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            lines, sizes = [], []
            for html in batch.column("html").to_pylist():
                found = blocks(html or "")
                lines.append([xxh64_intdigest(b.text.encode("utf-8", "surrogatepass")) - (1 << 63) for b in found])
                sizes.append([len(b.text) for b in found])
            columns = [*(batch.column(c) for c in ("key", "host", "path")), pa.array(lines, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "host", "path", "lines", "sizes"])

    part = [F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*)?([^?#]*)(.*)$", i) for i in (1, 2, 3)]
    return pages.select("key", F.lower(part[0]).alias("host"), F.concat_ws(" ", part[1], part[2]).alias("path"), "html").mapInArrow(
        run, "key long, host string, path string, lines array<long>, sizes array<int>"
    )


def align(pages: pd.DataFrame) -> pd.DataFrame:
    """The lines that each page of a chunk shares with the nearest page before and after it on its host that isn't its copy."""
    rows = list(pages.sort_values("at").itertuples(index=False))
    met: dict[tuple[int, int], list[tuple[int, int]] | None] = {}

    def pairs(i: int, j: int) -> list[tuple[int, int]] | None:
        if (i, j) not in met:
            x, y = rows[i], rows[j]
            found = lcs(list(x.lines), list(y.lines))
            copy = sum(x.sizes[k] for k, _ in found) >= COPY_SHARE * max(1, min(sum(x.sizes), sum(y.sizes)))
            met[i, j] = None if copy else found
        return met[i, j]

    out = []
    for i, r in enumerate(rows):
        if r.guest:
            continue
        shared: set[int] = set()
        for step in (-1, 1):
            for j in range(i + step, i + step * (NEAR + 1), step):
                if not 0 <= j < len(rows) or rows[j].host != r.host or rows[j].at != r.at + j - i:
                    break
                found = pairs(min(i, j), max(i, j))
                if found is not None:
                    shared.update(p[step < 0] for p in found)
                    break
        if shared:
            out.append((r.host, r.same, sorted(shared)))
    return pd.DataFrame(out, columns=["host", "same", "shared"])


def shared_lines(pages: DataFrame) -> DataFrame:
    """key and positions of the lines that a page shares with the nearest pages of its host, of pages with any.

    Of the pages of a host with the same lines one is taken, at the first of their paths. These are put in the order of host
    and path by range partitions and cut into chunks, so that one host may hold any part of the table; NEAR
    pages at a chunk's ends go to both chunks. A page among more near copies than that has no partner on their side.
    """
    found = staged(outlines(pages).withColumn("same", F.xxhash64("lines")), "html-outlines")
    different = found.groupBy("host", "same").agg(F.min(F.struct("path", "key")).alias("f"), F.first("lines").alias("lines"), F.first("sizes").alias("sizes"))
    different = different.select("host", "same", F.col("f.path").alias("path"), F.col("f.key").alias("key"), "lines", "sizes")
    n = F.lit(CHUNK)
    ordered = ordered_index(different, ["host", "path", "key"], "at")
    chunk, inside = F.floor(F.col("at") / n), F.pmod("at", n)
    ordered = ordered.withColumn("chunk", F.explode(F.array_compact(F.array(chunk, F.when((inside < NEAR) & (chunk > 0), chunk - 1), F.when(inside >= n - NEAR, chunk + 1)))))
    ordered = ordered.withColumn("guest", F.col("chunk") != chunk)
    shared = ordered.groupBy("chunk").applyInPandas(align, "host string, same long, shared array<int>")
    return found.select("key", "host", "same").distinct().join(shared, ["host", "same"]).select("key", "shared").dropDuplicates(["key"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html).

    A null html is empty and gives an empty text, and so does a page without an article; a null
    url has an empty host and path. Repeated rows are all kept and give the same text. An empty
    table gives no rows; other columns don't matter.
    """
    keyed = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("key"))
    shared = staged(shared_lines(keyed), "html-shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(chosen(blocks(h or ""), set(s or ()))) for h, s in zip(batch.column("html").to_pylist(), batch.column("shared").to_pylist())]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    few = shared.limit(BROADCAST_PAGES + 1).count() <= BROADCAST_PAGES
    joined = keyed.join(F.broadcast(shared) if few else shared, "key", "left").select("page_id", "url", "html", "shared")
    return joined.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
