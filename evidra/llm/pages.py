"""Content and link features of pages, computed in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed word list: frequent function words of English, German, French and Spanish, as written text has them and lists of keywords don't.
FUNCTION_WORDS = frozenset((
    "the a an of to and was were is are for with on at by that this it its no not as so had has have been after before if when than be we i you who which whose could should would there their over under into each then only "
    "le la les l un une et ou de du des d est était a à au aux ce cette pas n si encore chaque dans nous il elle qui que aucun rien sur pendant après avec pour par sans mais "
    "der die das und oder ein eine einen nicht im ist war sind wurde wird auf mit von den dem noch zu wir hat er es ob für diese dieser über nach vor bei ohne aber obwohl bitte sein "
    "el los las un una se en del al y o por para con su lo es era falta no fue ha antes pero como más este esta que hay"
).split())
#: A line is written if one in so many of its words is a function word.
WRITTEN = 10
#: A sentence of so many words or more that is said again counts once where it is asked how different the words of a page are.
SENTENCE_WORDS = 5
NAMES = (
    "words", "distinct", "distinct_pairs", "function_words", "bare_share", "bare_distinct", "sentences", "link_share", "links", "anchors", "tags", "trails",
    "separators", "prices", "models", "digits", "times", "labels", "capitals", "line_words", "alike_begins", "code",
)
#: Characters of a batch that are looked at together.
CHUNK = 500_000

_LINK = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+")
#: A link with its markup and its text.
_LINKED = re.compile(r"<a\s[^<>]*>[^<>]*</a>|\[[^\[\]]*\]\([^()\s]*\)|" + _LINK.pattern)
_MARKUP = re.compile(r"<[^<>]*>|\]\([^()]*\)")
_ANCHOR = re.compile(r"<a\s|\]\(")
_WORD = re.compile(r"[^\W_]+")
_ROW = re.compile(r"\n|\s[|•-]\s|<br>")
_BEGIN = re.compile(r"[\W\d_]*([^\W\d_]+(?:\s+[^\W\d_]+)?)")
_LABEL = re.compile(r"\s*(?:[^\W\d]|_)+\s*:(?:\s|$)")
_SENTENCES = re.compile(r"(?<=[.!?؟])\s+|(?<=。)")
_WIDE = {x: x - 0xFEE0 for x in range(0xFF01, 0xFF5F)}
_IS_WIDE = re.compile("[！-～]")

UPPER, LOWER, SPACE, DIGIT, ENDER, CLOSER, SEPARATOR, MONEY = (1 << i for i in range(8))


def _classes() -> np.ndarray:
    """The classes of each character of the basic plane; those beyond have none."""
    out = np.zeros(0x10000, np.uint16)
    for i in range(0x10000):
        x = chr(i)
        kind = unicodedata.category(x)
        out[i] = UPPER * (kind == "Lu") | LOWER * (kind in ("Ll", "Lo")) | SPACE * x.isspace()
    for chars, bit in (("0123456789", DIGIT), (".!?؟。", ENDER), ("\"')»”", CLOSER), (",;|•/·", SEPARATOR), ("$€£", MONEY)):
        for x in chars:
            out[ord(x)] |= bit
    return out


class Reader:
    """Features of many pages at once: counts of characters over whole batches, words page by page."""

    def __init__(self) -> None:
        self.classes = _classes()

    def counts(self, texts: list[str]) -> dict[str, np.ndarray]:
        """How often each pattern of characters stands in each of some texts."""
        codes = np.frombuffer("".join(f"\n\n\n{t}\n\n\n\n\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.where(codes < 0x10000, self.classes[np.minimum(codes, 0xFFFF)], 0)
        starts = np.concatenate([[0], np.cumsum([len(t) + 8 for t in texts[:-1]])]).astype(np.int64) if texts else np.zeros(0, np.int64)
        has = lambda bit: (kind & bit) != 0
        total = lambda mask: np.add.reduceat(mask.astype(np.int32), starts)
        space, digit, upper, lower, ender = has(SPACE), has(DIGIT), has(UPPER), has(LOWER), has(ENDER)

        def after(mask: np.ndarray, by: int) -> np.ndarray:
            """The mask of what stands `by` characters later (earlier if negative)."""
            out = np.zeros(len(mask), bool)
            if by > 0:
                out[:-by] = mask[by:]
            else:
                out[-by:] = mask[:by]
            return out

        closed = after(space, 1) | (after(has(CLOSER), 1) & after(space, 2))
        word = upper | lower | digit | (codes == ord("_"))
        # up to three capitals, a hyphen, and two to four digits, as one word
        capitals = after(upper, -1) & (~after(word, -2) | (after(upper, -2) & (~after(word, -3) | (after(upper, -3) & ~after(word, -4)))))
        number = after(digit, 1) & after(digit, 2) & (~after(word, 3) | (after(digit, 3) & (~after(word, 4) | (after(digit, 4) & ~after(word, 5)))))
        clock = (codes == ord(":")) & after(digit, -1) & after(digit, 1) & after(digit, 2)
        return {
            "sentences": total(ender & after(lower, -1) & closed),
            "tags": total((codes == ord("#")) & after(space, -1) & (after(lower, 1) | after(upper, 1))),
            "trails": total((codes == ord(">")) & after(space, -1) & after(space, 1)),
            "separators": total(has(SEPARATOR) & after(space, 1)),
            "prices": total(has(MONEY) & (after(digit, 1) | (after(space, 1) & after(digit, 2)))),
            "models": total((codes == ord("-")) & capitals & number),
            "digits": total(digit),
            "times": total(clock & ~after(clock, -3)),
            "capitals": total(upper),
            "letters": total(upper | lower),
        }

    def words(self, t: str) -> tuple:
        """What is counted by words and lines of one text."""
        links = anchors = 0
        kept = unlinked = t
        bare = 0
        if "://" in t or "www." in t:
            kept = _LINKED.sub("", t)
            links = len(_LINK.findall(t))
            unlinked = _LINK.sub(" ", _MARKUP.sub(" ", t))
        if "<a" in t or "](" in t:
            anchors = len(_ANCHOR.findall(t))
        words, bare_words, unlike = [], [], []
        function_words = 0
        lowered = unlinked.lower()
        sentences = _SENTENCES.split(lowered)
        again = len({*sentences}) < len(sentences)
        said: set[str] = set()
        for line in lowered.split("\n"):
            found = _WORD.findall(line)
            if not found:
                continue
            words += found
            known = sum(map(FUNCTION_WORDS.__contains__, found))
            function_words += known
            new = found
            if again:
                new = []
                for sentence in _SENTENCES.split(line):
                    own = _WORD.findall(sentence)
                    short = len(own) < SENTENCE_WORDS and not (sentence[-1:] == "。" and len(sentence) > 2 * SENTENCE_WORDS)
                    if short or sentence[-1:] not in ".!?؟。" or sentence not in said:
                        new += own
                        said.add(sentence)
            unlike += new
            if known * WRITTEN < len(found):
                bare += len(found)
                bare_words += new
        pairs = {*zip(unlike, unlike[1:])}
        rows = [x for x in _ROW.split(t.lower()) if x.strip(" ")]
        begins = {m[1] if (m := _BEGIN.match(x)) else "" for x in rows}
        lines = labels = 0
        for x in t.split("\n"):
            if x and not x.isspace():
                lines += 1
                if ":" in x and _LABEL.match(x):
                    labels += 1
        code = sum(map(kept.count, '\\{}=_"'))
        return (
            len(words), len(unlike), len({*unlike}), len(pairs), function_words, bare, len(bare_words), len({*bare_words}),
            len(t) - len(kept), links, anchors, len(rows), len(begins), lines, labels, code,
        )

    def features(self, texts: list[str]) -> pd.DataFrame:
        """One row of NAMES for each text."""
        texts = [t.translate(_WIDE) if _IS_WIDE.search(t) else t for t in texts]
        many = self.counts(texts)
        w = np.array([self.words(t) for t in texts], float).reshape(len(texts), 16)
        size, unlike, distinct, pairs, known, bare, bare_unlike, bare_distinct, linked, links, anchors, rows, begins, lines, labels, code = w.T
        n, lines, chars = np.maximum(size, 1), np.maximum(lines, 1), np.maximum([len(t) for t in texts], 1)
        out = {
            "words": np.log1p(size), "distinct": distinct / np.maximum(unlike, 1), "distinct_pairs": pairs / np.maximum(unlike, 1), "function_words": known / n, "bare_share": bare / n,
            "bare_distinct": np.where(bare_unlike > 0, bare_distinct / np.maximum(bare_unlike, 1), 1.0), "sentences": many["sentences"] / n,
            "link_share": linked / chars, "links": links / lines, "anchors": anchors / lines, "tags": many["tags"] / n, "trails": many["trails"] / lines,
            "separators": many["separators"] / n, "prices": many["prices"] / n, "models": many["models"] / n, "digits": many["digits"] / chars,
            "times": many["times"] / lines, "labels": labels / lines, "capitals": many["capitals"] / chars, "line_words": n / lines,
            "alike_begins": 1 - begins / np.maximum(rows, 1), "code": code / chars,
        }
        return pd.DataFrame({x: np.where(size + many["letters"] + chars > 1, out[x], 0.0) for x in NAMES})


def page_features(pages: DataFrame, text: str) -> DataFrame:
    """`pages` with content and link features of each page as a struct `f` of doubles; a null or empty text has zeros.

    Shares are of words or characters of the whole text. Nothing here names a keyword: what counts is how often the same
    words and pairs of words return, whole sentences that are said again aside, how much of the text stands in lines
    almost without function words, and how much of it is links, separators, tags or prices.
    Texts go to Python in Arrow batches and are read once there: characters are counted over whole batches, words page by page.
    """

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for batch in batches:
            texts = [t or "" for t in batch]
            parts, a = [], 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= CHUNK):
                    size += len(texts[b])
                    b += 1
                parts.append(reader.features(texts[a:b]))
                a = b
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=list(NAMES), dtype=float)

    return pages.withColumn("f", F.pandas_udf(read, ", ".join(f"{x} double" for x in NAMES))(F.col(text)))
