"""Messages: alerts within a length budget, and packing of an edition's lines into as few messages as fit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import cut, escape_html, utf16_length

ALERT_UNITS, MESSAGE_UNITS = 4000, 3900
LINE_TITLE = 120


def alert_text(title: Column, excerpt: Column, link: Column, outlets: Column, units: int = ALERT_UNITS) -> Column:
    """Title, excerpt, outlets and link; the excerpt shrinks by fifths, then the title, until all fit; the link never does."""
    tail = F.concat(F.lit("\n"), F.array_join(outlets, ", "), F.lit("\n"), link)

    def whole(t: Column, e: Column) -> Column:
        return F.concat(F.lit("<b>"), escape_html(t), F.lit("</b>\n"), escape_html(e), tail)

    tries = [whole(title, excerpt)] + [whole(title, cut(excerpt, n)) for n in (1600, 1280, 1024, 819, 655, 300)] + [whole(cut(title, n), F.lit("")) for n in (600, 200)]
    out = tries[-1]
    for t in reversed(tries[:-1]):
        out = F.when(utf16_length(t) <= units, t).otherwise(out)
    return out


def quiet(groups: Column, excerpt: Column, listed: list[str]) -> tuple[Column, Column]:
    """(excerpt, siren) of an alert: groups that are listed as quiet come without an excerpt and without the mark."""
    hushed = F.arrays_overlap(F.coalesce(groups, F.array().cast("array<string>")), F.array(*(F.lit(g) for g in listed)).cast("array<string>"))
    return F.when(hushed, F.lit("")).otherwise(excerpt), F.when(hushed, F.lit("")).otherwise(F.lit("🚨 "))


def story_card(stories: DataFrame) -> DataFrame:
    """What a page shows of a story, and the line that shares it (id, title, outlet, url, sources, more, share)."""
    more = F.size("sources") - 1
    named = F.when(more > 0, F.concat("outlet", F.lit(" +"), more.cast("string"))).otherwise(F.col("outlet"))
    return stories.select("id", cut(F.col("title"), LINE_TITLE).alias("title"), "outlet", "url", "sources", F.greatest(more, F.lit(0)).alias("more"), F.concat("title", F.lit(" — "), named, F.lit("\n"), "url").alias("share"))


def delay_note(created: Column, sent: Column, text: Column, minutes: int = 30) -> Column:
    late = F.floor((F.unix_seconds(sent) - F.unix_seconds(created)) / 60)
    return F.when(late > minutes, F.concat(text, F.lit("\n(delayed by "), late.cast("string"), F.lit(" min)"))).otherwise(text)


def digest_line(title: Column, outlet: Column, more: Column) -> Column:
    return F.concat(F.lit("• "), escape_html(cut(title, LINE_TITLE)), F.lit(" — "), escape_html(outlet), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(""))


def units(text: str) -> int:
    return len(text.encode("utf-16-le")) // 2


class Packer:
    """Blocks of lines into messages of bounded length. A block stays whole if it fits into a message at all; one that doesn't goes on in the next message under its header."""

    def __init__(self, limit: int = MESSAGE_UNITS):
        self.limit, self.message, self.size, self.split = limit, 0, 0, False

    def begin(self, header: str, block: int) -> tuple[int, str]:
        """A block of so many units, its header and lines joined."""
        gap = 2 if self.size else 0
        whole = block <= self.limit
        self.split = not whole
        if not self.message or self.size + gap + (block if whole else units(header)) > self.limit:
            self.message, self.size, gap = self.message + 1, 0, 0
        self.size += gap + units(header)
        return self.message, ("\n" if gap else "") + header

    def line(self, header: str, line: str) -> tuple[int, str]:
        need = 1 + units(line)
        if self.split and self.size + need > self.limit:
            header = f"{header} (continued)"
            self.message, self.size = self.message + 1, units(header) + need
            return self.message, f"{header}\n{line}"
        self.size += need
        return self.message, line


def packed(lines: DataFrame, limit: int = MESSAGE_UNITS) -> DataFrame:
    """(edition, message, of, text) for rows (edition, section_order, line_order, section, line).

    A section is a block: its name is the header. Sizes of blocks are summed up first; then a fold places them in order, holding the place
    in the current message only, so it can go on from any block. The number of a message isn't counted in its length.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, block, packer = object(), object(), None
        for p in parts:
            out = []
            for r in p.itertuples(index=False):
                if r.edition != now:
                    now, block, packer = r.edition, object(), Packer(limit)
                if r.section_order != block:
                    block = r.section_order
                    message, text = packer.begin(r.section, int(r.block))
                    out.append((r.edition, message, r.section_order, -1, text))
                message, text = packer.line(r.section, r.line)
                out.append((r.edition, message, r.section_order, r.line_order, text))
            yield pd.DataFrame(out, columns=["edition", "message", "section_order", "line_order", "text"])

    block = lines.groupBy("edition", "section_order").agg((F.sum(utf16_length(F.col("line")) + 1) + F.max(utf16_length(F.col("section")))).alias("block"))
    ready = lines.join(block, ["edition", "section_order"]).select("edition", "section_order", "line_order", "section", "line", "block").repartition("edition").sortWithinPartitions("edition", "section_order", "line_order")
    placed = ready.mapInPandas(run, "edition string, message int, section_order int, line_order int, text string")
    whole = placed.groupBy("edition", "message").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_order", "line_order", "text"))), lambda x: x["text"]), "\n").alias("text"))
    last = whole.groupBy("edition").agg(F.max("message").alias("of"))
    return whole.join(last, "edition").select("edition", "message", "of", "text")
