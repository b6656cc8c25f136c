"""Per-document text statistics, and documents that are no natural prose.

Statistics are taken line by line in Arrow batches, lines that recur within the
source aside. A Gaussian mixture is fitted to the standardised statistics of all
documents by expectation-maximisation, each step one pass that sends only sums
over components. It starts from the statistics of inspected examples, and the
examples also tell which components are prose, lists, tables or junk. A document is
what its likeliest components are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekha.llm import lines
from lekha.session import COLLECT_ROWS, cut, join_same, small

KINDS = ("prose", "list", "table", "junk")

#: What the mixture is fitted to.
FEATURES = ("log_words", "mean_word_length", "symbol_ratio", "end_punct_share", "common_share", "distinct_share", "list_share", "table_share", "junk_share")
STATS = ("n_words", "mean_word_length", "symbol_ratio", "end_punct_share", "common_share", "distinct_share", "list_share", "table_share", "junk_share", "n_body")

#: Inspected examples: shape and kind of documents as found by reading the corpus.
EXAMPLES: tuple[tuple[str, str], ...] = (
    ("prose", "The federal council of Tarapur supported the new tariff, although local growers rejected it. When the board met in 1954, it had already released 12 lakh acres. Few ministers spoke as plainly as the envoy of the bank after the vote.\n\nHowever, the report that the fund had prepared was not read in full. It was the assembly that finally amended the clause."),
    ("prose", "# Rural credit\n\nBetween 1950 and 1976 the cooperative societies lent\nmore to small farmers than the banks had done before.\nWhether they can go on depends on how soon the\ncommission reports. The board and the treasury have\nagreed to both.\n"),
    ("prose", "जब आयोग ने ऋण को नियंत्रित किया, तब नगर की परिषद ने कर को स्थगित किया। वर्ष 1923 में मंत्रालय ने समिति और जिले को पुनर्गठित किया। यद्यपि घाटी की नदी शांत थी, बाढ़ ने 1887 के बाद फसल को घटा दिया।"),
    ("prose", "**Heading**\n\nThe market fell sharply after the harvest failed. Lenders in the port recovered it by 1911.\n\n- Rural credit\n- Tax reform\n\nUnder the new plan, the province paid 23 lakh to its weavers, which the council of elders had demanded for ten years."),
    ("list", "- Rural credit\n- Valley of Tarapur\n- Ports and ministers\n- Local tax reform\n- Coastal fisheries\n- Famine and public granary\n- Weavers in Lakapur"),
    ("list", "Rural credit\nValley of Tarapur\nPorts and ministers\nLocal tax reform\nCoastal fisheries\nFamine and public granary\nWeavers in Lakapur\nBorder town"),
    ("list", "1. Rural credit\n2. Valley of Tarapur\n3. Ports and ministers\n4. Local tax reform\n5. Coastal fisheries\n6. Famine and public granary"),
    ("list", "Rural credit ........ 12\nValley of Tarapur ........ 15\nPorts and ministers ........ 31\nLocal tax reform ........ 44\nCoastal fisheries ........ 45"),
    ("list", "Rural credit: Valley of Tarapur\nPorts and ministers: Local tax reform\nCoastal fisheries: Famine and granary\nWeavers in Lakapur: Border town"),
    ("table", "| Unit | Yield | Area |\n| --- | --- | --- |\n| Tarapur valley | 466 | 21.6 |\n| Lakapur port | 720 | 19.8 |\n| Border town | 303 | 47.3 |"),
    ("table", "Unit;Yield;Area;Rate\nTarapur valley;n.a.;-;3250\nLakapur port;-;3267;9107\nBorder town;2262;n.a.;60.8\nCoast;1064;69%;n.a."),
    ("table", "Unit\tYield\tArea\tRate\nTarapur valley\tn.a.\t-\t3250\nLakapur port\t-\t3267\t9107\nBorder town\t2262\tn.a.\t60.8"),
    ("junk", "var a949=function(){return deterrence[72]||2097;};\nvar a66=function(){return mangrove[32]||1281;};\nvar d583=function(){return habitat[64]||9181;};\nvar b379=function(){return genome[6]||7010;};"),
    ("junk", "3fUs12g4GOu7NRZGiDmx0jD8OtlQFIBOQty/uOx5XXqNY/aZkBGMzwXB7Ofd\nMysFYsQlaWbX1ncEnQDVTCvCMQzdFdWHznk5xbzjCdDUIKOX8IJp3jFzVbNV\ng4TVcjgIY+fQWzK9bWE76rW9MN9d9KL1+aRB1RJX65Iy2rNlj9ACRMZNLeFA"),
    ("junk", "1e�1??�□□□?oo1□??�□a�?o □�□1 �\n1?ea?□eo1 1□�e□o�□�ao 11e ��e□?\n???□?1□1?□oe?a�11�o1□�"),
    ("junk", "à¤µà¤°à¥à¤· 1832 à¤®à¥à¤ à¤µà¥à¤²à¤®à¥ à¤ à¤à¥ à¤¸à¤®à¥à¤¦à¥ à¤¨à¥ à¤®à¤¤à¤¦à¤¾à¤¤à¤¾ à¤à¤°"),
    ("junk", "voters wells transparent commissioned understated logistics scholars press overstated debated envoys villages tanks nuclear pipeline manuscript pollution franchise deterrence copied integrity parliamentary architectural constitutional exported stored debated verdict"),
    ("junk", "budget budget budget budget budget budget budget budget budget budget budget budget budget budget budget budget budget budget budget budget budget budget budget budget budget budget budget"),
)

_WORD = re.compile(r"[^\W_]+(?:[̀-ͯऀ-ःऺ-ॏ॑-ॗॢ-ॣ'’-]+[^\W_]*)*")
_END = re.compile(r"[.!?।॥][\"'”’»)\]*_]*\s*\Z")
_STOP = re.compile(r"[.!?।॥][\"'”’»)\]*_]*(?=\s|$)")
_ITEM = re.compile(r"\s*(?:[-*•‣◦▪●–—·]|\(?(?:\d{1,3}|[A-Za-z]|[ivxlIVXL]{1,5})[.)]|\[\d{1,3}\])\s+(?=\S)")
_LEADER = re.compile(r"(?:\.{3,}|…|\s{2,}|(?:\. ){3,})\s*\d{1,4}\s*$")
_REFS = re.compile(r"^[^.!?।]{2,80}?(?:,\s*\d{1,4}(?:[-–]\d{1,4})?)+\s*$")
_HEAD = re.compile(r"\s*(?:#{1,6}\s|\*\*[^*]+\*\*\s*$)")
_CODE = re.compile(r"[{}<>=\[\]|\\^~`$@#_/;()&%+*]")
_ODD = re.compile(r"[�■-◿-\x00-\x08\x0e-\x1f\x7f-\x9f]")
_LATIN1 = re.compile(r"[\x80-\xff]")
_CELL = re.compile(r"\s*(?:[-–—]|n\.?\s?a\.?|N/?A|nil|[~≈<>±]?[₹$€£]?\s?[\d][\d,.]*\s?%?|:?-{2,}:?|)\s*$", re.IGNORECASE)
_SYMBOL = re.compile(r"[^\w\sऀ-ॿ.,;:!?'\"()।-]")
_LONG = re.compile(r"\S{30,}")
_DUMP = re.compile(r"(?:\b[0-9A-Fa-f]{2}\b[ :]){6}")
_SOLID = re.compile(r"[^\W_ऀ-ॿ]|[ऀ-ॿ]")
_PLAIN = re.compile(r"[A-Za-z“‘\"'][A-Za-z0-9 .,:!?'\"%()“”‘’–—-]*(?:;[A-Za-z0-9 .,:!?'\"%()“”‘’–—-]*)?$|[ऀ-ॿ][ऀ-ॿ0-9 ,.?!–-]*$")
_RULE = re.compile(r"[-|:=_*+.\s]+$")

#: Of SPAN words in a row under a share FEW are different where the same few words
#: come again and again.
SPAN, FEW = 80, 0.25
#: Words of a stretch whose share of different words is taken.
STRETCH = 400


def _cells(line: str) -> tuple[str, int, float]:
    """Delimiter, number of cells and share of cells that hold a number or a
    blank mark, for the delimiter that gives most cells."""
    best = ("", 1, 0.0)
    for mark in ("|", "\t", ";", ",", "  "):
        if mark in line:
            cells = line.strip().strip("|").split(mark) if mark != "  " else re.split(r"\s{2,}", line.strip())
            if len(cells) > 2 or mark == "|" and len(cells) > 1:
                if any(len(c.split()) > 6 for c in cells):
                    continue
                share = sum(bool(_CELL.match(c)) for c in cells) / len(cells)
                if (share, len(cells)) > (best[2], best[1]):
                    best = (mark, len(cells), share)
    return best


def _again(rows: list[str], whole: bool) -> list[int]:
    """Lines, by number, of which over half of the words come again within SPAN words in
    a row that are the same few again and again. Unless ``whole``, the words must also stand
    in a row without the end of a sentence."""
    found: dict[int, int] = {}
    words: list[str] = []
    owner: list[int] = []
    sizes = [0] * len(rows)

    def judge() -> None:
        n, size = len(words), min(SPAN, len(words))
        count = Counter(words[:size])
        end = 0
        for at in range(n - size + 1):
            if at:
                out = words[at - 1]
                count[words[at + size - 1]] += 1
                count[out] -= 1
                if not count[out]:
                    del count[out]
            if len(count) < FEW * size and (whole or n >= SPAN):
                # Of ordinary words next to the repeated ones, a window holds most once.
                for k in range(max(at, end), at + size):
                    if n <= SPAN or count[words[k]] > 1:
                        found[owner[k]] = found.get(owner[k], 0) + 1
                end = at + size
        words.clear()
        owner.clear()

    for i, row in enumerate(rows):
        for k, piece in enumerate([row] if whole else _STOP.split(row)):
            if k:
                judge()
            mine = [w.lower() for w in _WORD.findall(piece)]
            words += mine
            owner += [i] * len(mine)
            sizes[i] += len(mine)
    judge()
    every = sum(found.values()) == sum(sizes) > 0
    return [i for i, n in enumerate(sizes) if 2 * found.get(i, 0) > n or every]


def line_kinds(rows: list[str], common: frozenset[str]) -> list[str]:
    """Kind of each line: prose, list, table, junk, or "" for headings, blanks and a
    few marks alone."""
    n = len(rows)
    kinds = [""] * n
    shape: list[tuple[str, int, float]] = [("", 1, 0.0)] * n
    free = []
    for i, line in enumerate(rows):
        s = line.strip()
        if not s:
            continue
        size = len(s)
        # A few marks are nothing by themselves.
        if size < 8 and s[0] != "|" and not any(map(str.isalnum, s)):
            continue
        plain = _PLAIN.match(s)
        if "|" in s or "\t" in s or ";" in s or "  " in s or s.count(",") > 1:
            shape[i] = _cells(line)
        if plain and size > 60 and shape[i][1] == 1 and s[1:2] not in ").":
            free.append(i)
            continue
        solid = size - s.count(" ")
        if not plain and (len(_ODD.findall(s)) > 0.12 * solid or not s.isascii() and len(_LATIN1.findall(s)) > 0.3 * solid or size > 7 and len(_SOLID.findall(s)) < 0.4 * solid and not (_RULE.match(s) or shape[i][2] >= 0.4) or _DUMP.search(s)):
            kinds[i] = "junk"
        elif shape[i][2] >= 0.4 and (shape[i][1] > 2 or s[0] == "|"):
            kinds[i] = "table"
        elif s[-1] == ":" or _HEAD.match(line):
            continue
        elif _ITEM.match(line) and not (_STOP.search(s.split(None, 1)[-1]) and len(s.split()) > 9):
            kinds[i] = "list"
        elif not plain and size > 12 and s[0] != "|" and len(_CODE.findall(s)) > 0.12 * solid:
            kinds[i] = "junk"
        elif (long := _LONG.search(s)) and len(long[0]) > 0.6 * solid and any(c.isdigit() or c in "+/=%" for c in long[0]):
            kinds[i] = "junk"
        elif (_LEADER.search(line) or _REFS.match(s)) and len(s.split()) < 14:
            kinds[i] = "list"
        else:
            free.append(i)
    # A header row has as many cells as the row of numbers after it.
    for i in free:
        if shape[i][1] > 2 and i + 1 < n and kinds[i + 1] == "table" and shape[i + 1][:2] == shape[i][:2]:
            kinds[i] = "table"
        elif rows[i].lstrip()[:1] == "|" and (i and kinds[i - 1] == "table" or i + 1 < n and kinds[i + 1] == "table"):
            kinds[i] = "table"
    # What is left: runs of neighbouring lines, each a paragraph or a plain list.
    runs: list[list[int]] = []
    for i in free:
        if kinds[i]:
            continue
        if runs and runs[-1][-1] == i - 1:
            runs[-1].append(i)
        else:
            runs.append([i])
    titles = []
    for run in runs:
        stops = [bool(_STOP.search(rows[i])) for i in run]
        sizes = [rows[i].count(" ") + 1 for i in run]
        # Words without a sentence: hardly any mark or common word, or the same few words again and again.
        parts = _STOP.split("\n".join(rows[i] for i in run)) if sum(sizes) >= 15 else []
        if parts and (len(parts) - 1) * SPAN < sum(sizes):
            flat = [w.lower() for i in run for w in _WORD.findall(rows[i])]
            known = sum(map(common.__contains__, flat)) / max(1, len(flat))
            marks = sum(rows[i].count(c) for i in run for c in ".,;:!?।")
            if known < 0.06 and marks * 40 < len(flat) and max(sizes) > 9:
                for i in run:
                    kinds[i] = "junk"
                continue
            for k in _again([rows[i] for i in run], True):
                kinds[run[k]] = "junk"
        elif any(p.count(" ") + p.count("\n") >= SPAN - 1 for p in parts):
            for k in _again([rows[i] for i in run], False):
                kinds[run[k]] = "junk"
        for k, i in enumerate(run):
            if kinds[i]:
                continue
            s = rows[i].strip()
            after = rows[run[k + 1]].lstrip()[:1] if k + 1 < len(run) else ""
            opens = not k or stops[k - 1] and _END.search(rows[run[k - 1]]) or run[k - 1] in titles[-1:]
            hindi = s[:1] >= "ऀ" and s[:1] <= "ॿ"
            if stops[k] or sizes[k] > 9 or s[-1:] in ",;" or (hindi and any(stops)):
                kinds[i] = "prose"
            elif opens and not (after.islower() or s[:1].islower()):
                titles.append(i)
            else:
                kinds[i] = "prose"
    # Title lines are a list where three or more follow each other, blank lines aside.
    full = [i for i in range(n) if rows[i].strip()]
    at = {i: k for k, i in enumerate(full)}
    group: list[int] = []
    for i in [*titles, -1]:
        if group and (i < 0 or at[i] != at[group[-1]] + 1):
            for j in group if len(group) > 2 else ():
                kinds[j] = "list"
            group = []
        group.append(i)
    return kinds


def statistics(text: str | None, common: frozenset[str], skip: frozenset[int] | set[int] = frozenset()) -> tuple[float, ...]:
    """STATS of one text; lines whose identifier is in ``skip`` are set aside for the
    shares by kind; distinct_share is the mean over stretches of STRETCH words, each
    as heavy as it is long; n_body counts the characters of lines that have a kind. All are 0 for a null or blank text."""
    if not text or not text.strip():
        return (0.0,) * len(STATS)
    rows = text.split("\n")
    body = [r for r in rows if not skip or line_id(r) not in skip]
    words = _WORD.findall(text.lower())
    full = [r for r in rows if r and not r.isspace()]
    chars = dict.fromkeys(("", *KINDS), 0)
    for r, k in zip(body, line_kinds(body, common), strict=True):
        chars[k] += len(r.strip())
    total = max(1, sum(chars.values()))
    solid = max(1, len(text) - text.count(" ") - text.count("\n"))
    n = max(1, len(words))
    return (
        float(len(words)), sum(map(len, words)) / n, len(_SYMBOL.findall(text)) / solid, sum(map(bool, map(_END.search, full))) / len(full),
        sum(map(common.__contains__, words)) / n, sum(len(set(words[k : k + STRETCH])) for k in range(0, len(words), STRETCH)) / n, chars["list"] / total, chars["table"] / total, chars["junk"] / total, float(sum(chars.values()) - chars[""]),
    )


_EDGE = re.compile(f"[{lines._PUNCT}{lines._SPACE}]+")


def line_id(line: str) -> int:
    """Identifier of a line, as lines.line_ids gives it."""
    s = _EDGE.sub(" ", line).strip(" ").lower().strip(" ")
    if not s:
        return 0
    x = xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42)
    return x - (1 << 64) if x >> 63 else x


def stats(docs: DataFrame, common: DataFrame, recurring: DataFrame | None = None, key: str = "doc_id", source: str = "source", text: str = "text", collect_rows: int = COLLECT_ROWS) -> DataFrame:
    """``key`` and STATS of every row's whole text.

    ``common`` has the common words (a word list: over 100,000 rows are an error),
    ``recurring`` the recurring lines of each source (source, line_id). Up to
    ``collect_rows`` of these go out to the workers; more are joined to the lines of
    the texts, and only their numbers to the texts. Null and blank texts give zeros;
    null keys, ties and repeated rows stay, one row out for each in.
    """
    words = [r.word for r in common.select("word").distinct().limit(100_001).collect() if r.word]
    if len(words) > 100_000:
        raise ValueError("stats: more than 100,000 common words")
    src = docs.select(F.col(key).alias(key), F.col(source).alias("source"), F.col(text).cast("string").alias("text"))
    gone: dict[str | None, set[int]] = {}
    if recurring is not None and small(recurring, collect_rows):
        for r in recurring.collect():
            gone.setdefault(r.source, set()).add(r.line_id)
    elif recurring is not None:
        # Equal texts of one source have the same lines, whatever their keys.
        same = src.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text")})
        at = same.dropDuplicates(["source", "h1", "h2"]).select("source", "h1", "h2", F.explode(lines.line_ids(F.col("text"))).alias("line_id")).filter("line_id <> 0")
        at = join_same(at, recurring.select("source", "line_id"), ["source", "line_id"], "left_semi").groupBy("source", "h1", "h2").agg(F.collect_set("line_id").alias("gone"))
        src = join_same(same, at, ["source", "h1", "h2"], "left").select(key, "source", "text", "gone")
    shared = docs.sparkSession.sparkContext.broadcast((frozenset(w.lower() for w in words), gone))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, skip = shared.value
        for b in batches:
            own = b.column(3).to_pylist() if b.num_columns > 3 else [None] * b.num_rows
            out = [statistics(t, known, set(g) if g else skip.get(s, frozenset())) for s, t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), own, strict=True)]
            table = np.array(out, dtype=np.float64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(table[:, k]) for k in range(len(STATS))]], names=[key, *STATS])

    return src.mapInArrow(run, f"`{key}` {src.schema[0].dataType.simpleString()}, " + ", ".join(f"{c} double" for c in STATS))


#: How steeply the shares by kind rise about one half.
STEEP = 0.05


def _features(table: np.ndarray) -> np.ndarray:
    """FEATURES from columns of STATS: words as a logarithm, and each share by kind as
    how surely it is over one half, since a document is of the kind of its greater part."""
    out = table[:, : len(FEATURES)].copy()
    out[:, 0] = np.log1p(out[:, 0])
    out[:, -3:] = 1 / (1 + np.exp((0.5 - out[:, -3:]) / STEEP))
    return out


def _log_density(x: np.ndarray, weight: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    gap = x[:, None, :] - mean[None]
    return np.log(weight)[None] - 0.5 * (np.log(2 * np.pi * var).sum(1)[None] + (gap * gap / var[None]).sum(2))


def _responsibility(x: np.ndarray, weight: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    log = _log_density(x, weight, mean, var)
    log -= log.max(1, keepdims=True)
    r = np.exp(log)
    return r / r.sum(1, keepdims=True)


class Mixture:
    """Gaussian mixture with diagonal covariances over standardised features."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, weight: np.ndarray, mean: np.ndarray, var: np.ndarray, kinds: list[str]) -> None:
        self.centre, self.scale, self.weight, self.mean, self.var, self.kinds = centre, scale, weight, mean, var, kinds

    def by_kind(self, table: np.ndarray) -> np.ndarray:
        """Probability of each of KINDS, for rows of STATS."""
        r = _responsibility((_features(table) - self.centre) / self.scale, self.weight, self.mean, self.var)
        return np.stack([r[:, [k == kind for k in self.kinds]].sum(1) for kind in KINDS], 1)


def fit(table: DataFrame, common: frozenset[str], rounds: int = 10, floor: float = 0.05) -> Mixture:
    """The mixture of all rows of ``table`` that are not blank. Variances don't go
    below ``floor``, in units of the whole corpus's variance."""
    some = table.filter("n_body > 0")
    columns = [F.log1p("n_words"), *[F.col(c) for c in FEATURES[1:-3]], *[1 / (1 + F.exp((0.5 - F.col(c)) / STEEP)) for c in FEATURES[-3:]]]
    row = some.agg(F.count(F.lit(1)), *[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    d = len(FEATURES)
    n = row[0]
    examples = _features(np.array([statistics(t, common) for _, t in EXAMPLES]))
    centre = np.array(row[1 : d + 1] if n else examples.mean(0), float)
    scale = np.maximum(np.array(row[d + 1 :] if n else examples.std(0), float), 1e-3)
    mean = (examples - centre) / scale
    labels = [k for k, _ in EXAMPLES]
    k = len(mean)
    weight, var = np.full(k, 1 / k), np.full((k, d), 0.5)
    start = mean.copy()
    for _ in range(rounds if n else 0):
        state = (weight, mean, var)

        def sums(batches: Iterator[pa.RecordBatch], state: tuple = state) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, 1 + 2 * d))
            for b in batches:
                x = np.stack([b.column(i).to_numpy() for i in range(b.num_columns)], 1) if b.num_rows else np.zeros((0, len(FEATURES)))
                x = (_features(x) - centre) / scale
                r = _responsibility(x, *state)
                total += np.concatenate((r.sum(0)[:, None], r.T @ x, r.T @ (x * x)), 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["at", "value"])

        got = some.select(*STATS[: len(FEATURES)]).mapInArrow(sums, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        total = np.zeros(k * (1 + 2 * d))
        for r in got:
            total[r.at] = r.value
        total = total.reshape(k, 1 + 2 * d)
        # One document's worth of each start keeps a component that nothing falls to.
        size = total[:, :1] + 1
        new = (total[:, 1 : d + 1] + start) / size
        var = np.maximum((total[:, d + 1 :] + start * start + 0.5) / size - new * new, floor)
        step, mean, weight = np.abs(new - mean).max(), new, size[:, 0] / size.sum()
        if step < 1e-3:
            break
    # A component is of the kind of the examples that are nearest to its mean in the
    # shares by kind, which mean the same in every corpus.
    at = [FEATURES.index(f"{kind}_share") for kind in KINDS[1:]]
    shares, of = (mean * scale + centre)[:, at], examples[:, at]
    kinds = [labels[int(((of - row) ** 2).sum(1).argmin())] for row in shares]
    return Mixture(centre, scale, weight, mean, var, kinds)


def classify(table: DataFrame, mixture: Mixture, key: str = "doc_id") -> DataFrame:
    """``key``, kind and probability of each document that is no natural prose: the
    kind to whose components it most likely belongs. Blank ones are nothing."""
    shared = table.sparkSession.sparkContext.broadcast(mixture)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(1 + i).to_numpy() for i in range(len(STATS))], 1) if b.num_rows else np.zeros((0, len(STATS)))
            p = shared.value.by_kind(x)
            which = p.argmax(1)
            at = np.flatnonzero((which != KINDS.index("prose")) & (x[:, -1] > 0))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([KINDS[w] for w in which[at]], pa.string()), pa.array(p[at, which[at]], pa.float64())], names=[key, "kind", "probability"])

    src = table.select(key, *STATS)
    return src.mapInArrow(run, f"`{key}` {src.schema[0].dataType.simpleString()}, kind string, probability double")


def not_prose(docs: DataFrame, common: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``key``, kind (list, table, junk) and probability of the documents that are no
    natural prose, lines recurring within their source aside. Null, empty and blank
    texts are none; repeated rows of a key give one case per kind."""
    recurring = lines.recurring_ids(lines.lines_of(docs, key, source, text))
    table = cut(stats(docs, common, recurring, key, source, text))
    words = frozenset(r.word.lower() for r in common.select("word").distinct().collect() if r.word)
    return classify(table, fit(table, words), key).groupBy(key, "kind").agg(F.max("probability").alias("probability"))
