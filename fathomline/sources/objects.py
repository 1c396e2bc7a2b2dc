"""JSON inside pages, read without regard to how long, deep or broken it is."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A broken object is given up beyond this many starts that all fail at one place: each costs all that lies between.
SAME_END = 64


class Reader:
    """Decodes JSON values at places of one text, in time that grows with the text.

    Objects around one broken place all fail there; after ``SAME_END`` of them, and at once where nesting is
    deeper than the decoder goes, no start before that place is tried any more.
    """

    _decoder = json.JSONDecoder()

    def __init__(self, text: str):
        self.text, self.ends, self.fails, self.closed = text, -1, 0, 0

    def at(self, start: int) -> tuple[object, int] | None:
        """The value that begins here and its end; null if there is none."""
        size = 256
        while start >= self.closed:
            # by growing pieces, as the decoder's error counts the lines of all it was given
            piece = self.text[start : start + size]
            try:
                value, end = self._decoder.raw_decode(piece)
                return value, start + end
            except RecursionError:
                self.closed = len(self.text)
            except ValueError as broken:  # also numbers that are too long
                end = getattr(broken, "pos", 0)
                cut = end >= len(piece) - 16 or str(broken).startswith("Unterminated string")
                if cut and start + size < len(self.text):
                    size *= 4
                    continue
                self.fails = self.fails + 1 if start + end == self.ends else 1
                self.ends = start + end
                if self.fails >= SAME_END:
                    self.closed = self.ends
                return None
        return None


def sound(text: str) -> str:
    """The text with halves of surrogate pairs, as in cut texts, joined or replaced by U+FFFD."""
    try:
        text.encode("utf-8")
    except UnicodeEncodeError:
        return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return text


def objects_after(html: str | None, mark: str) -> list[str]:
    """The text of every JSON object that follows the mark, in document order; broken ones are left out."""
    out, at, html = [], 0, html or ""
    read = Reader(html)
    while (at := html.find(mark, at)) >= 0:
        at += len(mark)
        start = at
        while html[start : start + 1].isspace():
            start += 1
        if html.startswith("{", start) and (found := read.at(start)):
            out.append(html[start : found[1]])
    return out


def objects_column(html: Column, mark: str) -> Column:
    """objects_after of each page; a worker holds a hundred pages at a time, as an Arrow batch of 10,000 has no bound in bytes."""
    found = F.udf(lambda h: objects_after(h, mark), "array<string>", useArrow=False)
    return found(html)
