"""Defective answers among prompt and response pairs.

An answer is read out of its JSON, fence or plain text and then judged in Arrow
batches: copies by compressing it with its prompt as a zstandard dictionary,
refusals and other languages by dictionaries, broken ends by a model of terminal
contexts that is fitted to all answers and all places where they can be cut.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFECTS = ("empty", "truncated", "refusal", "copy", "language")

#: Texts that stand for no answer.
PLACEHOLDERS = frozenset("null none nil na n/a n.a. nan undefined tbd todo tba empty blank unknown (none) (empty) (blank) [none] <none> no answer not available not applicable no response".split() + ["no answer", "not available", "not applicable", "no response", "to be added", "to be filled"])

#: What says that one declines to answer.
REFUSALS = re.compile(
    r"""
    \b(?:i\s?['’]?a?m|i\s+am|we\s+are|we['’]re)\s+(?:really\s+|very\s+|so\s+)?(?:sorry|afraid|unable|not\s+able|not\s+in\s+a\s+position|not\s+allowed|not\s+permitted)\b
    | \bi\s+(?:must|have\s+to|need\s+to|will\s+have\s+to|would\s+have\s+to|respectfully|shall)?\s*(?:decline|refuse|apologi[sz]e|abstain|refrain)\b
    | \bi\s*(?:can\s?not|can['’]t|could\s+not|couldn['’]t|won['’]t|will\s+not|would\s+not|do\s+not|don['’]t|shall\s+not|am\s+unable)\s+(?:be\s+able|help|assist|answer|provide|give|offer|respond|reply|comment|discuss|grade|explain|complete|do\s+(?:this|that)|have\s+(?:enough|sufficient|the\s+information)|feel\s+able|wish)
    | \bi['’]?(?:d|\s+would)\s+(?:rather|prefer)\s+(?:not|to\s+not)\b
    | \b(?:no\s+answer|no\s+reply|nothing)\s+(?:can|could|will)\s+be\s+(?:offered|given|provided)\s+(?:from\s+my\s+side|by\s+me|here)
    | \b(?:this|that|the)\s+(?:request|question|topic|task)\s+(?:falls|is|lies|goes)\s+(?:outside|beyond)\s+(?:what|my|of\s+what|the\s+scope)
    | \b(?:not\s+be\s+(?:appropriate|right|possible|proper)|inappropriate|not\s+possible|impossible)\s+for\s+me\s+to\b
    | \bmy\s+(?:guidelines|instructions|policy|policies|rules|programming|training)\s+(?:do\s+not|don['’]t|does\s+not|forbid|prevent|prohibit)
    | \bas\s+an?\s+(?:ai|study|language|virtual|digital|automated)\b[^.]{0,40}?\b(?:i\s+(?:must|can|do|am|will)|model)
    | \bsorry,?\s+(?:but\s+)?(?:i|this|that|we)\b
    | क्षमा\s+(?:करें|कीजिए|करना)|माफ\s*(?:़)?\s*(?:करें|कीजिए|करना)|मुझे\s+खेद|खेद\s+है
    | (?:मैं|मुझे|मेरे\s+लिए|मुझसे|हम)[^।.]{0,60}?(?:असमर्थ|सक्षम\s+नहीं|नहीं\s+दे\s+सक|नहीं\s+कर\s+सक|संभव\s+नहीं|सम्भव\s+नहीं|मना\s+कर|इनकार|उचित\s+नहीं|नहीं\s+दे\s+पा|अनुमति\s+नहीं)
    | मेरे\s+पास[^।.]{0,40}?(?:जानकारी|सूचना|उत्तर)[^।.]{0,20}?नहीं
    | \b(?:kshama|maaf|mujhe\s+khed)\b[^.]{0,30}\b(?:karen|kare|kijiye|hai)\b | \bmain\b[^.]{0,40}\bnahin?\s+(?:de|kar)\s+sak
    """,
    re.IGNORECASE | re.VERBOSE,
)
#: A refusal says little else: so much of its words at least stand in sentences that
#: refuse, or in what its kind adds to them (an offer of other help, advice, thanks).
REFUSAL_SHARE = 0.3

#: Frequent words of languages in Latin letters, Hindi among them.
WORDS_OF = {
    "en": "the of and to in is that for it as was with be by on not at are this have from or had which were all there would their been has when who will if its than into them can only other may after before during although because while whether under between near whom these both every few".split(),
    "hi": "ke ki ko to se jab mein ne aur hai hain ka kar karna kiya kiye gaya gayi tha thi thhe nahin nahi par yah yeh woh vah jab tab aayi aaya liye saath tak bhi logon karan di diya badal tod rok jo bina sthaniya nayi naya".split(),
    "es": "el la los las de del que y en un una unos por con para su sus cerca como pero aunque era fue es son al se lo más entre sobre durante desde".split(),
    "fr": "le la les des du et en un une dans que qui est sont pour par sur avec au aux ce cette mais bien près était pendant ont plus ne pas".split(),
    "de": "der die das und ist sind in den dem ein eine einer nicht mit auf für von zu im während nahe war wurde bei nach auch obwohl".split(),
    "pt": "o a os as de do da dos das que e em um uma por com para perto embora era foi não ao mais entre durante".split(),
    "nl": "de het een en van in op dat die is was zijn niet met voor aan te bij ook maar door over uit naar dan nog wel werd werden heeft hebben tijdens tussen omdat hoewel hun haar deze dit er om als".split(),
    "it": "il lo la gli le di del della che e in un una per con vicino era fu non al più tra durante sebbene".split(),
}
#: Frequent words of Hindi in its own letters.
DEVANAGARI = frozenset("के का की को में से ने पर और है हैं था थे थी हो कि यह वह इस उस एक तक भी नहीं जो तथा या लिए साथ कर किया किए गया गई गए हुआ हुई हुए जब तब अपने अपनी अपना यदि तो बाद इन उन द्वारा परन्तु किन्तु लेकिन यद्यपि ही रहा रही रहे वर्ष दिया दी".split())
_LATIN = {w: {k for k, ws in WORDS_OF.items() if w in ws} for ws in WORDS_OF.values() for w in ws}
_TOKEN = re.compile(r"[^\W\d_]+(?:[ऀ-ॣ]+[^\W\d_]*)*")
_FENCE = re.compile(r"^```[A-Za-z]*[ \t]*\n?(.*?)(\n?[ \t]*```[ \t]*)?$", re.DOTALL)
_LETTER = re.compile(r"^\W*(?:(?:the\s+)?(?:correct\s+)?(?:answer|option|ans|उत्तर|विकल्प)\s*(?:is|:|-|है)?\s*)?\(?([A-Da-d1-4])\)?\s*(?:[.):\-]|\n|$)", re.IGNORECASE)
_LEAD = re.compile(r"^\W*(?:answer|option|ans|उत्तर)\s*[:\-]\s*\(?[A-Da-d]\)?[.):]?\s*", re.IGNORECASE)
_ITEM = re.compile(r"\s*(?:[-*•]|\(?\d{1,2}[.)]|\(?[a-z][.)])\s+\S")
_ENDS = re.compile(r"[.!?।॥…][\"'”’»)\]}*_`\s]*\Z")


def _texts(value: object) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for v in value.values():
            yield from _texts(v)
    elif isinstance(value, list):
        for v in value:
            yield from _texts(v)


def _numbers(value: object) -> bool:
    if isinstance(value, dict):
        return any(_numbers(v) for v in value.values())
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def blank(text: str) -> bool:
    """Whether a text holds nothing usable: no letter or digit, or a placeholder."""
    t = text.strip().strip("\"'`*. ").lower()
    return t in PLACEHOLDERS or not any(c.isalnum() for c in t)


class Answer:
    """A response taken apart: the answer's texts, whether it chose an option or
    gave a number, and the state of the JSON around it (none, closed, open)."""

    def __init__(self, raw: str | None) -> None:
        self.texts, self.chosen, self.state = [], False, "none"
        s = (raw or "").strip()
        fence = _FENCE.match(s)
        if fence:
            s = fence[1].strip()
            self.state = "closed" if fence[2] is not None else "open"
        if s[:1] in "{[" and s[:1]:
            try:
                value = json.loads(s)
                self.state = self.state if self.state == "open" else "closed"
            except ValueError:
                self.state = "open"
                value = None
                s = re.sub(r'^[{\[]?\s*"\w+"\s*:\s*', "", s)
            if value is not None:
                self.texts = [t.strip() for t in _texts(value) if not blank(t)]
                self.chosen = _numbers(value) or any(_LETTER.match(t) and len(t) < 4 for t in self.texts)
                self.texts = [t for t in self.texts if len(t) > 3 or not _LETTER.match(t)]
                return
        if not blank(s):
            self.texts = [s]
            lead = _LEAD.match(s)
            if lead or len(s) < 4 and _LETTER.match(s):
                self.chosen = True
                rest = s[lead.end() :].strip() if lead else ""
                self.texts = [rest] if rest else []

    @property
    def text(self) -> str:
        return " ".join(self.texts)


def prompts(raw: str | None) -> list[str]:
    """The long texts of a prompt: question, article or student's answer, options
    and settings aside."""
    if not raw:
        return []
    try:
        value = json.loads(raw)
    except ValueError:
        return [raw]
    if not isinstance(value, dict):
        return list(_texts(value))
    return [v for k, v in value.items() if isinstance(v, str) and k not in ("paper", "subject", "date")]


def _flat(text: str) -> bytes:
    return " ".join(_TOKEN.findall(text.lower())).encode()


def copied(answer: str, prompt: str) -> float:
    """Compressed size of an answer with its prompt as dictionary, against without:
    near 0 for a copy, near 1 for a text of its own."""
    a, p = _flat(answer), _flat(prompt)
    # The prompt as it is, once or several times, whatever its length.
    if a and p and not (b" " + a).replace(b" " + p, b""):
        return 0.0
    if len(a) < 20 or len(p) < 20:
        return 1.0
    dictionary = zstandard.ZstdCompressionDict(p, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    kwargs = {"level": 3, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
    small = len(zstandard.ZstdCompressor(dict_data=dictionary, **kwargs).compress(a))
    alone = len(zstandard.ZstdCompressor(**kwargs).compress(a))
    return max(0, small - 9) / max(1, alone - 9)


def shared_words(a: list[str], prompt: str) -> float:
    """Share of the answer's words that the prompt has; a prompt that is given back
    several times has them all."""
    p = set(_TOKEN.findall(prompt.lower()))
    return sum(w in p for w in a) / max(1, len(a))


_SENTENCE = re.compile(r"[.!?।;]\s+|\n")


def own_sentence(answer: str, prompt: str) -> bool:
    """Whether the answer has a sentence of eight words or more of which hardly any
    two neighbouring words are neighbours in the prompt."""
    p = _TOKEN.findall(prompt.lower())
    pairs = set(zip(p, p[1:], strict=False))
    for s in _SENTENCE.split(answer.lower()):
        w = _TOKEN.findall(s)
        if len(w) >= 8 and sum(x in pairs for x in zip(w, w[1:], strict=False)) < 0.35 * (len(w) - 1):
            return True
    return False


#: Above this ratio an answer is no copy, and under this share of shared words it
#: can't be one.
COPY_RATIO, COPY_WORDS = 0.45, 0.7


#: Of a text in its own language fewer than one word in twenty-five is a frequent one
#: only by chance; a text of so many words leaves no doubt.
OWN_SHARE, SURE_WORDS = 0.04, 24
#: Ranges of the scripts that count as the record's own.
_SCRIPT = {"en": re.compile(r"[A-Za-z\u00c0-\u024f\u1e00-\u1eff]"), "hi": re.compile(r"[\u0900-\u097f]")}
_ALPHA = re.compile(r"[^\W\d_]|[\u0900-\u097f]")
_ITEM_LINE = re.compile(r"(?m)^\s*(?:[-*•]|\(?\d{1,2}[.)]|\(?[a-z][.)])\s+[^.!?।]*$")


def other_language(text: str, tokens: list[str], language: str | None) -> bool:
    """Whether a whole text, with its words in lower case, is in another language than ``language`` (en or hi).

    Letters in the main of a script that is neither the record's own nor Latin are
    another language at any length, as are Devanagari letters in an English record.
    What is left is judged by frequent words: those of another language are there and
    the own ones missing, or the own ones are missing in sentences of SURE_WORDS words
    or more, whatever the language.
    """
    own = {"en": "en", "hi": "hi"}.get((language or "").strip().lower()[:2])
    if not own:
        return False
    # In texts of one script only, letters needn't be counted.
    if not (text.isascii() and own == "en"):
        n = {k: len(rx.findall(text)) for k, rx in _SCRIPT.items()}
        every = len(_ALPHA.findall(text))
        if every and n["en"] + n[own] < 0.2 * every:
            return True
        if own == "hi" and n["hi"] > 0.5 * every:
            return len(tokens) >= SURE_WORDS and sum(map(DEVANAGARI.__contains__, tokens)) < OWN_SHARE * len(tokens)
    score: Counter = Counter()
    for t, times in Counter(tokens).items():
        if "ऀ" <= t[0] <= "ॿ":
            score["hi"] += times
        else:
            of = _LATIN.get(t)
            for k in of or ():
                score[k] += times / len(of)
    n = len(tokens)
    rest = sum(v for k, v in score.items() if k != own)
    if n < 5:
        # A few words: another language's frequent ones, none of the own.
        return n > 1 and not score[own] and rest >= 1
    if score[own] >= OWN_SHARE * n + 0.5:
        return False
    if rest > 0.1 * n and rest > 3 * score[own]:
        return True
    prose = _TOKEN.findall(_ITEM_LINE.sub(" ", text.lower()))
    return len(prose) >= SURE_WORDS and sum(own in _LATIN.get(t, ()) for t in prose) < OWN_SHARE * len(prose)


_CLAUSE = re.compile(r"(?<=[.!?।;])\s+|\n")
#: What refusals add: offers, advice, thanks.
_BESIDE = re.compile(r"\b(?:please|kindly|instead|i\s+(?:can|could|would|hope|suggest|recommend|understand|appreciate)|let\s+me\s+know|feel\s+free|thank)\b|कृपया|धन्यवाद", re.IGNORECASE)


#: Each of REFUSALS in Latin letters has one of these words.
_REFUSING = frozenset("i im iam we sorry me my ai study language virtual digital automated answer reply nothing request question topic task kshama maaf mujhe main".split())


def refuses(text: str, words: list[str]) -> bool:
    """Whether a text, with its words in lower case, declines to answer: it refuses,
    and says little else."""
    if text.isascii() and _REFUSING.isdisjoint(words) or not REFUSALS.search(text):
        return False
    said = every = 0
    for s in _CLAUSE.split(text):
        n = len(s.split())
        every += n
        said += n * bool(REFUSALS.search(s) or _BESIDE.search(s))
    return said >= REFUSAL_SHARE * every


def context(answer: Answer) -> tuple:
    """Terminal context of an answer's last text."""
    text = answer.texts[-1] if answer.texts else ""
    line = text.rsplit("\n", 1)[-1]
    tail = text.rstrip()[-1:]
    kind = "stop" if _ENDS.search(text) else "mark" if tail and not tail.isalnum() and not "ऀ" <= tail <= "ॿ" else "word"
    words = line.split()
    last = words[-1].lower().strip(".,;:") if words else ""
    return (answer.state, kind, "item" if "\n" in text and _ITEM.match(line) and len(words) <= 12 else "short" if len(text.split()) <= 3 else "line", "joint" if kind == "word" and last in _LATIN else "plain")


_SPACED = re.compile(r"(\S+)(\s*)")
_ITEM_MARK = re.compile(r"[-*•]|\(?\d{1,2}[.)]|\(?[a-z][.)]")
_LONGEST = max(map(len, _LATIN))


#: Places by kind are counted in one number: so many bits for each of s(top), m(ark),
#: w(ord) and j(oint).
_ONE = {c: 1 << 40 * k for k, c in enumerate("smwj")}


@lru_cache(maxsize=100_000)
def _kinds(word: str, stopped: bool) -> tuple[str, int]:
    """How a text ends after each letter of a word, as in ``context``, and how often
    each way with one space after the word. ``stopped``: what is before it is a stop."""
    kinds, last = [], "s" if stopped else "w"
    lead = len(word) - len(word.lstrip(".,;:"))
    for k, c in enumerate(word, 1):
        if c in ".!?।॥…" or last == "s" and c in "\"'”’»)]}*_`":
            last = "s"
        elif c.isalnum() or "ऀ" <= c <= "ॿ":
            last = "j" if k - lead <= _LONGEST and word[lead:k].lower() in _LATIN else "w"
        else:
            last = "m"
        kinds.append(last)
    return "".join(kinds), sum(map(_ONE.__getitem__, kinds)) + _ONE[last]


def cut_contexts(text: str, first: int = 20) -> Counter:
    """How often each context, but for the state of the JSON, comes up when a text with
    no space at its ends is cut at each place from ``first`` to before its last letter.
    One pass over its words, whatever its length."""
    found = {"item": 0, "short": 0, "line": 0}
    at = in_line = 0
    marked = stopped = later = False
    for n, (word, space) in enumerate(_SPACED.findall(text), 1):
        in_line += 1
        if in_line == 1:
            marked = later and _ITEM_MARK.fullmatch(word) is not None
        line = "item" if marked and 2 <= in_line <= 12 else "short" if n <= 3 else "line"
        # Words may be as long as texts; only short ones are remembered.
        kinds, spaced = (_kinds if len(word) <= 40 else _kinds.__wrapped__)(word, stopped)
        last = kinds[-1]
        stopped = last == "s"
        if space == " " and at + 1 >= first:
            found[line] += spaced
            at += len(word) + 1
            continue
        end = at + len(word)
        for c, one in _ONE.items():
            found[line] += one * kinds.count(c, max(0, first - at - 1), len(text) - 1 - at)
        rows = space.split("\n", 1)
        # Spaces leave the line as it is; after a line break it is empty.
        found[line] += _ONE[last] * max(0, min(len(rows[0]), end + len(rows[0]) - first + 1))
        at = end + len(space)
        if len(rows) > 1:
            found["short" if n <= 3 else "line"] += _ONE["w" if last == "j" else last] * max(0, min(len(rows[1]) + 1, at - first + 1))
            in_line, marked, later = 0, False, True
    names = {"s": ("stop", "plain"), "m": ("mark", "plain"), "w": ("word", "plain"), "j": ("word", "joint")}
    n = {(names[c][0], line, names[c][1]): v // one & (1 << 40) - 1 for line, v in found.items() if v for c, one in _ONE.items()}
    return Counter({c: v for c, v in n.items() if v})


class TerminalContexts:
    """Log-odds that an answer breaks off, from counts of terminal contexts at the
    ends of answers and at all places where answers could be cut."""

    #: Parts of one answer's cuts; whole numbers add up alike in any order.
    PARTS = 1 << 20

    def __init__(self, ends: Counter, cuts: Counter, prior: float = 0.05) -> None:
        self.ends, self.cuts, self.prior = ends, cuts, prior

    @classmethod
    def fit(cls, texts: Iterable[str | None]) -> TerminalContexts:
        return cls.of(*cls.counts(texts))

    @classmethod
    def of(cls, ends: Counter, parts: Counter) -> TerminalContexts:
        return cls(ends, Counter({c: v / cls.PARTS for c, v in parts.items()}))

    @classmethod
    def counts(cls, texts: Iterable[str | None]) -> tuple[Counter, Counter]:
        """Counts at the ends of answers, and at all places where their last texts can
        be cut, in parts: each answer has PARTS, however long it is. Half of the cuts of
        closed JSON leave it open."""
        ends, parts = Counter(), Counter()
        for raw in texts:
            a = Answer(raw)
            if not a.texts:
                continue
            ends[context(a)] += 1
            last = a.texts[-1]
            if len(last) > 40:
                states = ("open", "closed") if a.state == "closed" else (a.state,)
                for c, n in cut_contexts(last).items():
                    for state in states:
                        parts[(state, *c)] += n * cls.PARTS // ((len(last) - 20) * len(states))
        return ends, parts

    def score(self, c: tuple) -> float:
        n, m = sum(self.ends.values()) + 1, sum(self.cuts.values()) + 1
        cut = (self.cuts[c] + 0.5) / m
        # A share ``prior`` of the ends is itself broken off and looks like the cuts. No
        # share is under half an answer's, so a floor doesn't outgrow what is counted.
        whole = max(min(1e-4, 0.5 / n), (self.ends[c] + 0.5) / n - self.prior * cut)
        return math.log(cut / whole)

    def broken(self, answer: Answer) -> bool:
        """An open JSON is broken off in any case."""
        if answer.state == "open":
            return True
        return bool(answer.texts) and self.score(context(answer)) > 0


def defect(raw: str | None, prompt: str | None, language: str | None, task: str | None, ends: TerminalContexts) -> str | None:
    """The defect of one answer, or none."""
    a = Answer(raw)
    if a.state != "open" and not a.texts:
        return None if a.chosen else "empty"
    text = a.text
    words = _TOKEN.findall(text.lower())
    if refuses(text, words):
        return "refusal"
    if a.state == "open":
        return "truncated" if a.texts else "empty"
    for p in prompts(prompt):
        if shared_words(words, p) >= COPY_WORDS and copied(text, p) <= COPY_RATIO and not own_sentence(text, p):
            return "copy"
    if other_language(text, words, language):
        return "language"
    return "truncated" if ends.broken(a) else None


def fit_ends(answers: DataFrame) -> TerminalContexts:
    """The model of terminal contexts, from every row of ``answers`` that has an answer
    (column answer) and every place of each. Contexts are counted where rows are read;
    there are 36 at most, so only counts leave the tasks."""
    src = answers.filter("answer IS NOT NULL").select(F.col("answer").cast("string"))
    fields = pa.schema([(c, pa.string()) for c in ("state", "kind", "line", "joint")] + [("ends", pa.int64()), ("cuts", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, cuts = TerminalContexts.counts(t for b in batches for t in b.column(0).to_pylist())
        found = [(*c, ends[c], cuts[c]) for c in ends | cuts]
        yield pa.RecordBatch.from_pylist([dict(zip(fields.names, row, strict=True)) for row in found], schema=fields)

    counted = src.mapInArrow(run, "state string, kind string, line string, joint string, ends long, cuts long")
    rows = counted.groupBy("state", "kind", "line", "joint").agg(F.sum("ends").alias("ends"), F.sum("cuts").alias("cuts")).collect()
    return TerminalContexts.of(*(Counter({tuple(r[:4]): r[c] for r in rows if r[c]}) for c in ("ends", "cuts")))


def defects(pairs: DataFrame, keys: list[str], ends: TerminalContexts) -> DataFrame:
    """``keys`` and the defect (null for none) of every row. ``pairs`` has answer,
    prompt, language and task besides the keys. Null and blank answers are empty;
    null prompts and languages only switch off copies and other languages. One row
    out for each in; texts are read whole."""
    model = pairs.sparkSession.sparkContext.broadcast(ends)
    src = pairs.select(*keys, *[F.col(c).cast("string").alias(f"__{c}") for c in ("answer", "prompt", "language", "task")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(len(keys), len(keys) + 4)]
            found = [defect(*row, model.value) for row in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(found, pa.string())], names=[*keys, "defect"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[: len(keys)])
    return src.mapInArrow(run, f"{fields}, defect string")


def corpus_defects(corpus: DataFrame, ends: TerminalContexts) -> DataFrame:
    """pair_id and defect of defective training records; copies of a row count once,
    rows without id are left out."""
    pairs = corpus.select("pair_id", F.col("output").alias("answer"), F.col("input").alias("prompt"), "language", "task").filter("pair_id IS NOT NULL")
    return defects(pairs, ["pair_id"], ends).filter("defect IS NOT NULL").groupBy("pair_id").agg(F.min("defect").alias("defect"))


PREDICTION_KEY = ["run_id", "condition", "question_id", "inference_task"]


def prediction_defects(predictions: DataFrame, ends: TerminalContexts) -> DataFrame:
    """The prediction's key and defect. Of several rows with one key only that with
    the latest created_at counts (null the earliest, of ties the first defect by
    name). All rows are judged where they are read; only keys, times and defects
    are shuffled."""
    pairs = predictions.select(*PREDICTION_KEY, F.try_to_timestamp("created_at").alias("at"), F.col("raw_output").alias("answer"), F.col("input_text").alias("prompt"), "language", F.col("inference_task").alias("task"))
    judged = defects(pairs, [*PREDICTION_KEY, "at"], ends)
    last = judged.groupBy(*PREDICTION_KEY).agg(F.max_by(F.struct("defect"), F.struct("at", "defect")).alias("d"))
    return last.select(*PREDICTION_KEY, F.col("d.defect").alias("defect")).filter("defect IS NOT NULL")
