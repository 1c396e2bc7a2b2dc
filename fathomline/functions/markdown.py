"""Pages as markdown: headings, lists, tables and code kept as marks, all else as text. Columns only, so a page never leaves the JVM.

Links keep their text and images go, as a reader of the text needs neither. Null html gives null; a page without text gives "".

``main_part`` leaves out what stands around a page's content without saying so in its tags: menus, teasers, link
lists. A page is cut into blocks; a block gains by its words and loses by words in links, and the run of blocks with
the greatest sum is the content.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bound
from .text import element_pattern, unescaped, visible_text

# Elements around the text of a page that are not part of it, and elements that end a line.
AROUND = ["script", "style", "noscript", "svg", "template", "nav", "footer", "iframe"]
BLOCKS = ["p", "div", "section", "article", "main", "header", "aside", "blockquote", "ul", "ol", "dl", "dd", "dt", "figure", "figcaption", "form", "table", "thead", "tbody", "address", "details", "summary", "body", "html", "head", "title"]

#: What becomes of tags, in order: (pattern, replacement).
STEPS = [
    (element_pattern(AROUND), " "), (r"(?s)<!--.*?(?:-->|\z)", " "), (r"(?is)<title\b[^<>]*>.*?(?:</title\s*>|\z)", " "), (r"[\t\r\n ]+", " "),
    *[(rf"(?i)<h{n}\b[^<>]*>", "\n\n" + "#" * n + " ") for n in range(1, 7)], (r"(?i)</h[1-6]\s*>", "\n\n"),
    (r"(?i)<li\b[^<>]*>", "\n- "), (r"(?i)</li\s*>", "\n"), (r"(?i)<tr\b[^<>]*>", "\n| "), (r"(?i)</t[dh]\s*>", " | "), (r"(?i)</tr\s*>", "\n"), (r"(?i)</?(?:strong|b)>", "**"), (r"(?i)</?code>", "`"),
    (r"(?i)<br\s*/?>", "\n"), (rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^<>]*>", "\n\n"), (r"<[^<>]+>", ""), (r"[\x00-\x08\x0b-\x1f\x7f]", ""), (r" {2,}", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"),
]


def to_markdown(html: Column, main: bool = False) -> Column:
    """A page's text with its structure as marks, of its content only with ``main``; where that leaves nothing, all that is visible."""
    text = main_part(html) if main else html
    for pattern, mark in STEPS:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(mark.replace("$", "\\$")))
    trimmed = F.regexp_replace(unescaped(text), r"\A\s+|\s+\z", "")
    return bound(trimmed, lambda t: F.when(t != "", t).otherwise(unescaped(visible_text(html))))


#: What a block must have in words to count for the content, words in links counting against it; headings count as they are.
BLOCK_WORDS, LINK_WEIGHT = 3, 3
#: Of a content the least words, and the least share of the page's; below that the page is taken whole.
LEAST_WORDS, LEAST_SHARE = 20, 0.25
_STARTS = "|".join([*BLOCKS, "h[1-6]", "li", "tr", "td", "th", "br", "hr"])


def _words(html: Column) -> Column:
    return F.size(F.regexp_extract_all(F.regexp_replace(html, "<[^<>]++>", " "), F.lit(r"[^\s]++"), F.lit(0)))


def main_part(html: Column) -> Column:
    """The markup of a page's content, in whole blocks; all of the page where no run of blocks holds enough of it."""
    around = html
    for pattern in (element_pattern(AROUND), STEPS[1][0], STEPS[2][0]):
        around = F.regexp_replace(around, F.lit(pattern), F.lit(" "))

    def score(block: Column) -> Column:
        linked = F.aggregate(F.regexp_extract_all(block, F.lit(r"(?is)<a\b[^<>]*+>(?:(?!</?a\b).)*+"), F.lit(0)), F.lit(0), lambda n, a: n + _words(a))
        least = F.when(block.rlike("(?i)^<h[1-6]"), 0).otherwise(BLOCK_WORDS)
        # a block without words lies between others and is neither here nor there
        return bound(_words(block), lambda n: F.struct(F.when(n > 0, n - LINK_WEIGHT * linked - least).otherwise(0).alias("gain"), n.alias("words")))

    def best_run(scores: Column) -> Column:
        """The run with the greatest sum, the first of those that tie: its first block, the block behind it, and its words."""
        none = F.struct(*[F.lit(0).alias(n) for n in ("i", "sum", "first", "words", "best", "from", "to", "held")])

        def step(s: Column, one: Column) -> Column:
            fresh = s["sum"] <= 0
            now, first = F.when(fresh, 0).otherwise(s["sum"]) + one["gain"], F.when(fresh, s["i"]).otherwise(s["first"])
            words = F.when(fresh, 0).otherwise(s["words"]) + one["words"]
            better = now > s["best"]
            at = F.struct((s["i"] + 1).alias("i"), now.alias("sum"), first.alias("first"), words.alias("words"))
            return F.struct(*[at[n].alias(n) for n in ("i", "sum", "first", "words")], F.when(better, now).otherwise(s["best"]).alias("best"), F.when(better, first).otherwise(s["from"]).alias("from"), F.when(better, s["i"] + 1).otherwise(s["to"]).alias("to"), F.when(better, words).otherwise(s["held"]).alias("held"))

        return F.aggregate(scores, none, step)

    def cut(blocks: Column) -> Column:
        scores = F.transform(blocks, score)
        run = bound(scores, lambda s: F.struct(best_run(s).alias("r"), F.aggregate(s, F.lit(0), lambda n, x: n + x["words"]).alias("all")))
        enough = lambda x: (x["r"]["held"] >= LEAST_WORDS) & (x["r"]["held"] >= LEAST_SHARE * x["all"])
        return bound(run, lambda x: F.when(enough(x), F.array_join(F.slice(blocks, x["r"]["from"] + 1, x["r"]["to"] - x["r"]["from"]), "")).otherwise(html))

    return bound(F.split(around, rf"(?i)(?=<(?:{_STARTS})\b)"), cut)


def excerpt(text: Column, most: int) -> Column:
    """A text for a reader with little room: all of it, or its beginning and a note of how much there is."""
    whole = F.length(text)
    return F.when(whole <= most, text).otherwise(F.concat(F.lit(f"[the first {most} of "), whole.cast("string"), F.lit(" characters]\n\n"), F.substring(text, 1, most)))
