"""Problem 1: query-response pairs whose response is worthless, each with its kind of defect.

Two passes over the pairs and a few small joins:

* *Neighbours.* Responses without their torn ends are sorted by text (a range partitioning, so no key
  is hot) and each is compared with the one that follows it: a response that is a proper prefix of
  its neighbour is a shortened version. The same is done with the frames of sentences (frequent words
  kept, the others masked): an unfinished sentence whose frame only occurs continued is shortened.
* *Length limits.* A length at which far more unfinished responses end than at its neighbours is a
  limit; unfinished responses of that length were cut.
* *Endings.* How often the last words of an unfinished sentence end a sentence elsewhere is counted
  over all responses; an ending that hardly ever does is broken off.
* *Rules* for empty, copied, refusing and foreign responses, and for answers laid out in five steps.

A pair has at most one defect; they are tried in the order empty, copied_question, refusal,
other_language, truncated. A null, empty or blank response is ``empty``; with a null or empty query
nothing can be copied and its language is taken as unknown, so only the other defects apply. Very
long responses are processed whole. Repeated rows each get their row. Extra columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataclaim.llm.textmap import words
from strataclaim.session import write_cut

STEPS = 5
#: A word is kept in frames if at least this share of responses has it; so there are at most (words
#: a response / share) such words, which bounds the broadcast.
FRAME_SHARE = 0.03

# ---------------------------------------------------------------- language

#: Frequent function words by language (fixed lists).
FUNCTION_WORDS = {
    "en": "the of and to in is that for was with as are on by be this from at or were which an not have has but between how does when what no we it above after if then should using their under each appeared compared before",
    "de": "der die das und den dem des ein eine einer ist nicht mit auf für von zu im sich auch bei nach aus über wenn dass wie oder nur war sind wird werden durch keine ich kann diese dafür unter weil allerdings ohne welche muss aber dazu darf",
    "fr": "le la les des et est une un du en dans que qui pour pas sur avec par plus ne ce sont au aux mais chez cette nous je nos été sans peut entre après seulement ou d l n quelles faudrait car pendant",
    "es": "el la los las de y en que un una es por con para no se del al lo como más pero su sus o este esta muy sin sobre entre solo después hay porque cuando qué mis me durante hacen falta",
    "it": "il lo la i gli le di e in che un una è per con non si del della dei delle al alla da ma più come sono nel nella ha anche soltanto questo dopo senza tra dati circa",
    "pt": "o a os as de e em que um uma é por com para não se do da dos das ao mais como mas no na são sem após entre foi",
}
_WORD_LANGS: dict[str, tuple[str, ...]] = {}
for _lang, _ws in FUNCTION_WORDS.items():
    for _w in dict.fromkeys(_ws.split()):
        _WORD_LANGS[_w] = (*_WORD_LANGS.get(_w, ()), _lang)

_SCRIPTS = {
    "zh": regex.compile(r"\p{Han}"),
    "ja": regex.compile(r"[\p{Hiragana}\p{Katakana}]"),
    "ko": regex.compile(r"\p{Hangul}"),
    "ru": regex.compile(r"\p{Cyrillic}"),
    "ar": regex.compile(r"\p{Arabic}"),
    "he": regex.compile(r"\p{Hebrew}"),
    "el": regex.compile(r"\p{Greek}"),
    "hi": regex.compile(r"\p{Devanagari}"),
}
_LETTER = regex.compile(r"\p{L}")
#: Anything beyond Latin letters and general punctuation.
_OTHER_SCRIPT = regex.compile(r"[\u0370-\u1DFF\u2C00-\uD7FF\uF900-\U0010FFFF]")
_QUOTED = regex.compile(r"«[^»]*»|“[^”]*”|„[^“”]*[“”]|(?<!\w)\"[^\"\n]*\"|「[^」]*」|《[^》]*》")


def unquoted(text: str) -> str:
    """A text with its quotations as blanks."""
    return _QUOTED.sub(" ", text) if any(c in text for c in '«“„"「《') else text


def language(text: str) -> str | None:
    """The language most of a text is written in, or None if nothing tells.

    Scripts count by their share of letters, languages in Latin script by function words; words that
    several languages share count for each in part.
    """
    if not text.isascii() and _OTHER_SCRIPT.search(text):
        letters = len(_LETTER.findall(text))
        for lang, p in _SCRIPTS.items():
            # a letter of a script without spaces stands for more than one of a word
            if len(p.findall(text)) * (3 if lang in ("zh", "ja", "ko") else 1) > letters / 2:
                return lang
    score: Counter = Counter()
    for found, n in Counter(map(_WORD_LANGS.get, words(text))).items():
        for lang in found or ():
            score[lang] += n / len(found)
    if not score:
        return None
    (lang, most), *rest = score.most_common(2)
    return lang if most >= 1 and (not rest or most > 1.2 * rest[0][1]) else None


# ---------------------------------------------------------------- parts of a response

_STEP = regex.compile(r"(?im)^[^\p{L}\p{N}\n]*step\s*(\d+)\b")
_STEP_HEAD = regex.compile(r"(?i)^[^\p{L}\p{N}]*step\s*\d+\s*(?:[-–—:(]?\s*\**\s*\p{Lu}[\p{Lu} ]+\)?)?\s*\**\s*(?:[-–—:]+|$)\s*")
_MARKS = regex.compile(r"[^\p{L}\p{N}]+")
_CONTENT = regex.compile(r"[\p{L}\p{N}]")
_BULLET = regex.compile(r"^\s*[-*•]\s+")


def _step_text(line: str) -> str:
    """A line without the heading of a step."""
    return _STEP_HEAD.sub("", line) if "step" in line.lower() or "ſ" in line else line


#: What stands for an answer without being one (a fixed list, without marks, lower-cased).
PLACEHOLDERS = frozenset(
    "n a|na|none|null|nil|nan|empty|blank|no content|no answer|no response|no text|no output|not available|not applicable|unavailable|undefined|missing|tbd|todo|tba|answer|the answer|response|the response|reply|output|result|results|main points|key points|summary|conclusion|answer here|your answer here|insert answer|placeholder|begin answer|end answer|final answer|body|text|content".split("|")
)


def is_empty(response: str | None) -> bool:
    """Whether a response holds no answer content: blanks, marks, placeholders, bare headings."""
    if response is None or not _CONTENT.search(response):
        return True
    for line in response.split("\n"):
        line = _step_text(line)
        plain = _MARKS.sub(" ", line).strip().lower()
        if not plain or plain in PLACEHOLDERS:
            continue
        bare = line.strip().rstrip("*_ ")
        few = len(plain.split()) <= 6
        if few and bare.endswith(":") or bare.startswith("#") and few or bare.startswith("**") and line.strip().endswith("**") and len(plain.split()) <= 2:
            continue
        return False
    return True


#: Words of a frame about a question; a rest of them alone answers nothing.
_ANSWER_WORDS = frozenset("yes no maybe perhaps partly unclear unknown likely unlikely probably possibly sí nein ja oui non nicht peut kaum quizá vielleicht true false neither both".split())


def is_copied(query: str | None, response: str, frame: int = 8) -> bool:
    """Whether a response is the query, repeated or framed by up to ``frame`` words, and no answer."""
    q, r = words(query), words(response)
    if not q or len(r) < len(q):
        return False
    rest, k, found = [], 0, False
    while k < len(r):
        if r[k] == q[0] and r[k : k + len(q)] == q:
            k, found = k + len(q), True
        else:
            rest.append(r[k])
            k += 1
    return found and len(rest) <= frame and not _ANSWER_WORDS.intersection(rest)


_SENTENCE = re.compile(r"([.!?][\"'”’»)\]*_]{0,3})\s+|([。！？][\"'”’»)\]*_]{0,3})\s+|([。！？])|\n+")


def split_sentences(text: str) -> list[str]:
    """A text cut after stops with what closes them, at blanks; after full-width stops also without."""
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        out.append(text[at : m.end(m.lastindex) if m.lastindex else m.start()])
        at = m.end()
    out.append(text[at:])
    return out



_DENY = r"(?:can(?:no|['’])?t|can not|could not|couldn['’]t|won['’]t|will not|shall not|am not|['’]m not|is not|isn['’]t|am unable|['’]m unable|are unable|is unable|unable to|must decline|must refuse|must pass|have to pass|have to decline|decline to|refuse to|not able|not allowed|not permitted|not going to|do(?:es)? not|don['’]t|would not|wouldn['’]t|rather not|prefer not|may not|prefer to (?:stay|remain)|has blocked|have blocked|been instructed|been told|will leave|has been (?:blocked|disabled|restricted))"
_SPEAK = r"(?:answer|respon[ds]|reply|comment|discuss|assist|help|speak|talk|say|tell|judge|rank|assess|evaluat|provide|give|offer|share|complete|address|engage|opin|verdict|weigh|rate|advise|do that|fulfil|continue|silent|neutral|permitted to|allowed to|comfortable|appropriate|ranking)"
_ME = r"(?:\bI\b|\bI['’]m\b|\bI['’]d\b|\bme\b|\bmy\b|\bwe (?:assistants|models)\b|\b(?:this|the|an|your) (?:assistant|system|service|model|chatbot|bot|tool|ai)\b|\bassistant\b)"
REFUSALS = tuple(
    regex.compile(p, regex.I)
    for p in (
        rf"{_ME}(?:(?!\bthat ran\b|\bany trial\b).){{0,60}}?\b{_DENY}.{{0,60}}?{_SPEAK}",
        rf"\b{_DENY}\b.{{0,40}}?{_SPEAK}.{{0,40}}?{_ME}",
        rf"{_SPEAK}.{{0,80}}?(?:isn['’]t|is not|not) (?:possible|appropriate|allowed|permitted|something).{{0,20}}?{_ME}",
        rf"(?:beyond|outside(?: of)?|out of) (?:the scope of (?:this|my|what)|what I\b|my (?:remit|scope|abilities|expertise))",
        r"\bnot (?:something|anything|a (?:question|topic|matter)) (?:that )?(?:I|we|this assistant)\b.{0,20}?(?:permitted|allowed|able|free|can|may|going)",
        r"not (?:be )?(?:responsible|appropriate|right|proper) for me to",
        r"no comment (?:can|could|will|may) be",
        r"\bno can do\b|\bpass on this (?:one|question|request)\b",
        r"(?:talk|speak|chat) about something else",
        r"look elsewhere for",
        r"against (?:my|our) (?:\w+ )?(?:polic|guideline|rule|principle)",
        r"(?:my|our|the) (?:\w+ )?(?:guidelines|policy|policies|rules|instructions) (?:do(?:es)? not|don['’]t|doesn['’]t|prevents?|forbids?|prohibits?) (?:allow |permit |let )?(?:me|us)\b",
        r"stay silent on|leave this (?:unanswered|open for)",
        r"(?:system|filter|policy) has blocked",
        r"as an? (?:ai|language model|large language model)\b.{0,40}?\bI\b.{0,30}?\b(?:not|cannot|can['’]t|no|unable)\b",
        # German
        r"\b(?:kann|darf|möchte|werde|will) ich\b.{0,80}?\b(?:nicht|keine[nmr]?)\b|\bich\b.{0,30}?\b(?:kann|darf|möchte|werde|will)\b.{0,60}?\b(?:nicht|keine[nmr]?)\b.{0,60}?(?:beantwort|auskunft|äußer|helfen|bewert|sagen|stellung|geben|beurteil)|\bmuss ich\b.{0,80}?\b(?:ablehnen|verweigern|passen)|(?:ablehnen|nicht beantworten)\W*$|(?:regeln|richtlinien) (?:verbieten|erlauben) (?:es )?mir",
        # French
        r"\bje (?:ne|n['’])\s?(?:peux|puis|suis|saurais|veux|souhaite|dois)\b.{0,60}?(?:répond|aider|comment|prononcer|évalu|discut|juger|donner|traiter|autoris|en mesure)|\bm['’]interdi|préfère ne pas|\bje (?:dois|préfère) (?:refuser|décliner|m['’]abstenir)|je refuse|ne me permet(?:tent)? pas",
        # Spanish
        r"\bno (?:puedo|debo|quiero|podré|podría|estoy autorizad|tengo permitido|soy capaz)\b.{0,60}?(?:ayud|respond|coment|opin|valor|juzg|evalu|dar|contest|hablar)|\bnegarme\b|no me permiten?|prefiero no|debo (?:rechazar|declinar)|me niego",
        # Italian
        r"\bnon (?:posso|potrei|sono in grado|sono autorizzat|desidero)\b.{0,60}?(?:aiut|rispond|comment|valut|giudic|fornir|discut|esprim)|preferisco non|mi rifiuto|devo (?:rifiutar|declinar)|non mi (?:permett|consent)",
    )
)
#: A word or stem of each of the patterns above.
_GATE = regex.compile(
    r"(?i)\b(?:I|me|my|we|our|us|assistant|system|service|model|chatbot|bot|tool|ai|can do|pass on|ich|mir|je|m['’]interdi\w*|puedo|debo|quiero|podr\w*|estoy|tengo|soy|negarme|posso|potrei|sono|desidero|devo|mi)\b|scope of|no comment|something else|elsewhere|silent|unanswered|open for|has blocked|ablehn|beantwort|préfère|permet|permite|prefiero|niego|preferisco|rifiut|polic|guideline|principle|rules|instructions|richtlinien|regeln"
)
#: Parts, lower-cased, of which every match of the patterns above has one: a cheap look before the dear ones.
_PARTS = tuple(
    "not|n't|n’t|cant|unable|decline|refuse|must pass|have to pass|prefer|blocked|instructed|told|leave|disabled|restricted|beyond|outside|out of|comment|no can do|pass on|something else|elsewhere|against|guideline|policy|policies|rules|instructions|silent|unanswered|language model|as an ai|as a ai|"
    "ich|ablehn|mir|je |j'|m'|m’|préfère|permet|permite|puedo|debo|quiero|podr|estoy|tengo|soy|negarme|prefiero|niego|non|preferisco|rifiut|devo".split("|")
)


def may_refuse(text: str) -> bool:
    """Whether a text has a part that every refusing pattern has one of."""
    low = text.lower()
    if not low.isascii():
        # letters that patterns without case take for others
        low = low.replace("ſ", "s").replace("ı", "i").replace("i\u0307", "i")
    return any(x in low for x in _PARTS)


#: The gate's words, and the beginnings and longer parts it has beside them.
_GATE_WORDS = frozenset("i me my we our us assistant system service model chatbot bot tool ai ich mir je puedo debo quiero estoy tengo soy negarme posso potrei sono desidero devo mi".split())
_GATE_PARTS = tuple("can do|pass on|podr|interdi|scope of|no comment|something else|elsewhere|silent|unanswered|open for|has blocked|ablehn|beantwort|préfère|permet|permite|prefiero|niego|preferisco|rifiut|polic|guideline|principle|rules|instructions|richtlinien|regeln".split("|"))


def _may_pass_gate(text: str) -> bool:
    """True wherever the gate passes, and seldom elsewhere."""
    if not _GATE_WORDS.isdisjoint(words(text)):
        return True
    low = text.lower()
    return any(x in low for x in _GATE_PARTS) or "ſ" in text or "ı" in text or "İ" in text


_NUMBER = regex.compile(r"\d")
#: Signs of sentences that greet, thank, ask or send elsewhere (a fixed list).
_COURTESY = regex.compile(
    r"(?i)\b(?:thanks?|sorry|apologi[sz]e|apologies|hello|hi|dear|please|feel free|(?:happy|glad) to|questions?|another topic|let me know|consult|contact|you|your|leider|danke|bitte|frage|sie|merci|désolée?|vous|votre|veuillez|gracias|pregunta|lo siento|usted|grazie|domanda|mi dispiace)\b"
)
_ALL_FUNCTION_WORDS = frozenset(_WORD_LANGS)


def _topics(query: str | None) -> frozenset[str]:
    """The stems of a query's words of content."""
    return frozenset(w[:6] for w in words(query) if len(w) > 3 and w not in _ALL_FUNCTION_WORDS)


def is_refusal(response: str, query: str | None = None, most_answering: int = 2) -> bool:
    """Whether a response declines to answer and says nothing of substance besides.

    Quoted speech doesn't count. A response with a refusing sentence is one if the other sentences
    hold no figures and at most ``most_answering`` of them (an opening, advice) may be about the
    query, however long it is; greetings, thanks and offers aren't, nor is what has no word of the
    query. With a query without words of content every sentence may be about it.
    """
    said = unquoted(response)
    # most responses have none of the words that every refusal has one of
    if not may_refuse(said) or not _may_pass_gate(said):
        return False
    lines = map(_step_text, said.split("\n"))
    others, refusing = [], False
    for s in (s for line in lines for s in split_sentences(line) if s and _LETTER.search(s)):
        if may_refuse(s) and _may_pass_gate(s) and _GATE.search(s) and any(p.search(s) for p in REFUSALS):
            refusing = True
        elif _NUMBER.search(s):
            return False
        else:
            others.append(s)
    if not refusing:
        return False
    if len(others) <= most_answering:
        return True
    topics = _topics(query)
    answering = [s for s in others if not _COURTESY.search(s) and (not topics or any(w[:6] in topics for w in words(s)))]
    return len(answering) <= most_answering


def is_foreign(query: str | None, response: str) -> bool:
    """Whether a full answer is in another language than its query; quotations don't count."""
    a, b = language(query or ""), language(unquoted(response))
    return a is not None and b is not None and a != b


# ---------------------------------------------------------------- endings

_CITED = regex.compile(r"\s*(?:\[[\d,;\s–-]+\]|\((?:see|cf\.?|ref\.?|siehe|voir|véase)[^()]*\)|\(\d{4}\))\s*$")
_CLOSED = regex.compile(r"[.!?。！？؟][\"'”’»)\]*_`]*$")
_TORN = regex.compile(r"(?:\[\s*(?:cont\w*|more|truncated|cut|\.\.\.|…)?\s*\.*\s*\]?|\(\s*(?:cont\w*|more|\.\.\.|…)?\s*\)?|<(?:cont|more|truncated)[^>]*>|…|\.{2,}|[-–—,;([{/&+=<]|\*+|\n\s*(?:\d+[.)]?|[-*•]+)|#+)\s*$")
_LIST_MARK = regex.compile(r"\d+[.)]|[-*•]")
_FIGURE_LINE = regex.compile(r"(?i)^[^\p{L}\p{N}]*(?:overall\s+)?(?:confidence|verdict|score|certainty|rating)[^\p{L}\p{N}]*:?\W*[\d.,]+\s*%?(?:\s*\([\p{L} ]+\))?[^\p{L}\p{N}]*$")
#: Words after which no sentence ends (a fixed list of conjunctions, articles and prepositions).
_DANGLING = frozenset("and or but nor because whereas which that the a an of in on at by with from to for into than as if while although though its their our whose und oder aber weil dass der die das et ou mais parce que le la les des y o pero porque el los las e ma perché il lo gli".split())


def ending(response: str) -> tuple[str, str]:
    """How a response ends: ``closed``, ``torn``, or ``open``; with its last unit of text."""
    text = response.rstrip().rstrip("​﻿").rstrip()
    if text.endswith(("`", "_")):
        text = text.rstrip("`_\n ")
    last = text.rsplit("\n", 1)[-1]
    if _LIST_MARK.fullmatch(last.strip()):
        return "torn", ""
    if _FIGURE_LINE.match(last):
        return "closed", last
    bare = _CITED.sub("", text) if text.endswith(("]", ")")) else text
    if text.endswith("**") and _CLOSED.search(text.rstrip("* ")):
        bare = text.rstrip("* ")
    if not text.endswith(("...", "…")) and _CLOSED.search(bare):
        return "closed", last
    if bare == text and _TORN.search(text):
        return "torn", ""
    line = _step_text(_BULLET.sub("", bare.rsplit("\n", 1)[-1]))
    unit = [s for s in split_sentences(line) if s.strip()]
    ws = words(unit[-1]) if unit else []
    if not ws or ws[-1] in _DANGLING:
        return "torn", ""
    return "open", unit[-1]


def steps_missing(response: str, steps: int = STEPS) -> bool:
    """Whether an answer laid out in steps breaks off before its last step or inside its heading."""
    marks = list(_STEP.finditer(response)) if "step" in response.lower() or "ſ" in response else []
    if not marks or marks[0][1] != "1":
        return False
    if max(int(m[1]) for m in marks) < steps:
        return True
    tail = response[marks[-1].start() :].split("\n", 1)
    head = _STEP_HEAD.match(tail[0])
    return not words((tail[0][head.end() :] if head else "") + " ".join(tail[1:]))


def stat_words(text: str | None) -> list[str]:
    """Words for statistics: all numbers count as one."""
    return ["0" if w[0].isdigit() else w for w in words(text)]


def sentences_of(response: str) -> list[str]:
    """The finished sentences of a response, without list marks and headings."""
    out = []
    for line in response.split("\n"):
        line = _step_text(_BULLET.sub("", line)).strip()
        out += [s for s in split_sentences(line) if s and _CLOSED.search(s.rstrip()) and not s.rstrip().endswith(("...", "…"))]
    return out


def frame(sentence: str, frequent: frozenset[str]) -> str:
    """A sentence's frame: frequent words as they are, runs of other words as ``*``."""
    out: list[str] = []
    for w in stat_words(sentence):
        x = w if w in frequent else "*"
        if x != "*" or not out or out[-1] != "*":
            out.append(x)
    return " ".join(out)


# ---------------------------------------------------------------- the operator


def prefix_neighbours(df: DataFrame, text_col: str) -> DataFrame:
    """``(text, next_text)`` of distinct non-null texts in sorted order, where the next one extends it.

    Texts are range-partitioned and sorted; each is compared with its successor as they stream by,
    so nothing is gathered. The first text of each partition (one row a partition) settles the last
    one of the partition before it.
    """
    texts = df.select(F.col(text_col).alias("text")).where("text is not null").distinct()
    ordered = texts.repartitionByRange("text").sortWithinPartitions("text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, first = TaskContext.get().partitionId(), None, True
        names = ["kind", "part", "text", "next_text"]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]
        for b in batches:
            rows = []
            for t in b.column(0).to_pylist():
                if first:
                    rows.append(("head", part, t, None))
                    first = False
                elif t.startswith(before):
                    rows.append(("found", part, before, t))
                before = t
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        if before is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(("last", part, before, None), kinds)], names=names)

    out = write_cut(ordered.mapInArrow(compare, "kind string, part int, text string, next_text string"))
    edges = out.where("kind <> 'found'")
    # two rows a partition; the head of the following non-empty partition comes after the last
    follow = edges.withColumn("next_text", F.lead("text").over(Window.orderBy("part", F.when(F.col("kind") == "head", 0).otherwise(1)))).where("kind = 'last' and startswith(next_text, text)")
    return out.where("kind = 'found'").select("text", "next_text").unionByName(follow.select("text", "next_text"))


def length_limits(df: DataFrame, length_col: str, reach: int = 8, factor: float = 6.0, least: int = 30, share: float = 0.0005) -> DataFrame:
    """Lengths with far more rows than those around them: ``(length, n)``.

    A limit has at least ``share`` of all rows, so there are at most 1 / share of them.
    """
    n = df.groupBy(F.col(length_col).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    around = n.select(F.explode(F.sequence(F.col("length") - reach, F.col("length") + reach)).alias("length"), F.col("length").alias("own"), "n")
    around = around.where("length <> own").groupBy("length").agg(F.sum("n").alias("near"))
    total = df.count()
    return (
        n.join(around, "length", "left")
        .where((F.col("n") >= least) & (F.col("n") >= F.lit(share * total)) & (F.col("n") > factor * F.coalesce("near", F.lit(0)) / (2 * reach)))
        .select("length", "n")
    )


def _judge(steps: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, q, r in zip(*(b.column(k).to_pylist() for k in range(3))):
                defect = unit = stem = None
                if is_empty(r):
                    defect = "empty"
                elif is_copied(q, r):
                    defect = "copied_question"
                elif is_refusal(r, q):
                    defect = "refusal"
                elif is_foreign(q, r):
                    defect = "other_language"
                elif steps_missing(r, steps):
                    defect = "truncated"
                else:
                    how, last = ending(r)
                    if how == "torn":
                        defect = "truncated"
                    elif how == "open":
                        unit, stem = last, r.rstrip()
                ws = stat_words(unit)
                rows.append((i, defect, unit, stem, " ".join(ws[-2:]) if ws else None, ws[-1] if ws else None))
            names = ["id", "defect", "unit", "stem", "pair", "word"]
            yield pa.RecordBatch.from_arrays([pa.array(c, b.schema.field(0).type if k == 0 else pa.string()) for k, c in enumerate(zip(*rows))], names=names)

    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and word pairs, of those that end a sentence, and of responses with a word."""
    for b in batches:
        n: Counter = Counter()
        two: Counter = Counter()
        final: Counter = Counter()
        docs: Counter = Counter()
        for r in b.column(0).to_pylist():
            ws = words(r)
            n.update(ws)
            two.update(zip(ws, ws[1:]))
            docs.update(set(ws))
            for s in sentences_of(r):
                if x := stat_words(_CITED.sub("", s.rstrip(".!?。 "))):
                    final[x[-1]] += 1
                    if len(x) > 1:
                        final[" ".join(x[-2:])] += 1
        n.update({" ".join(k): c for k, c in two.items()})
        keys = list(n)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array([c[k] for k in keys], pa.int64()) for c in (n, final, docs))], names=["key", "n", "final", "docs"])


def _frames(frequent: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = Counter(frame(s, frequent) for r in b.column(0).to_pylist() for s in sentences_of(r))
            if c:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array(list(c.values()), pa.int64())], names=["frame", "n"])

    return run


def _unit_frames(frequent: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([frame(u, frequent) for u in b.column(2).to_pylist()], pa.string())], names=[*b.schema.names, "frame"])

    return run


def defective_pairs(df: DataFrame, id_col: str, query_col: str, response_col: str, steps: int = STEPS) -> DataFrame:
    """``(id_col, defect)`` of every defective pair."""
    src = df.select(F.col(id_col).alias("id"), F.col(query_col).alias("query"), F.col(response_col).alias("response"))
    id_type = src.schema["id"].dataType.simpleString()
    judged = write_cut(src.mapInArrow(_judge(steps), f"id {id_type}, defect string, unit string, stem string, pair string, word string"))
    known = judged.where("defect is not null").select("id", "defect")
    open_ = judged.where("unit is not null")

    responses = src.select("response").where("response is not null")
    counts = write_cut(responses.mapInArrow(_count_words, "key string, n bigint, final bigint, docs bigint").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n", "final", "docs"))))
    total = responses.count()
    # bounded: a word must be in FRAME_SHARE of all responses
    frequent = frozenset(r.key for r in counts.where((~F.contains("key", F.lit(" "))) & (F.col("docs") >= F.greatest(F.lit(5), F.lit(FRAME_SHARE * total)))).select("key").collect())

    # endings: a pair of words seen often enough decides, else its last word does
    p = counts.select(F.col("key").alias("pair"), F.col("n").alias("pair_n"), F.col("final").alias("pair_final"))
    w = counts.select(F.col("key").alias("word"), F.col("n").alias("word_n"), F.col("final").alias("word_final"))
    rated = open_.select("id", "stem", "unit", "pair", "word").join(p, "pair", "left").join(w, "word", "left")
    pair_says = F.col("pair_final") / F.col("pair_n")
    word_says = F.col("word_final") / F.col("word_n")
    odd_end = F.when(F.col("pair_n") >= 15, pair_says < 0.02).when(F.col("pair_final") > 0, F.lit(False)).otherwise(F.coalesce(word_says, F.lit(0.0)) < 0.03)

    # frames: unfinished ones that occur only continued
    full = responses.mapInArrow(_frames(frequent), "frame string, n bigint").groupBy("frame").agg(F.sum("n").alias("n")).where("n >= 3")
    framed = write_cut(rated.select("id", "stem", "unit", odd_end.alias("odd_end")).mapInArrow(_unit_frames(frequent), f"id {id_type}, stem string, unit string, odd_end boolean, frame string"))
    full = write_cut(full)
    longer = prefix_neighbours(framed.select("frame").unionByName(full.select("frame")), "frame").select(F.col("text").alias("frame"), F.lit(True).alias("goes_on"))
    framed = framed.join(full.select("frame", F.lit(True).alias("whole")), "frame", "left").join(longer, "frame", "left")

    # whole responses: shortened versions of their neighbours, and pile-ups at a length
    # without closing marks, as one that lacks only its full stop isn't shortened
    bare = lambda c: F.regexp_replace(c, r"[\s\p{P}]+$", "")
    stems = prefix_neighbours(open_.select(bare("stem").alias("stem")).unionByName(responses.select(bare("response").alias("stem"))), "stem").select(F.md5("text").alias("k"), F.lit(True).alias("shortened"))
    limits = F.broadcast(length_limits(open_.select(F.length("stem").alias("length")), "length").select("length", F.lit(True).alias("limit")))
    out = framed.withColumn("k", F.md5(bare("stem"))).withColumn("length", F.length("stem")).join(stems, "k", "left").join(limits, "length", "left")
    # beside the rules: endings, frames that are whole common prefixes of their neighbours, whole responses that are, lengths
    cut_off = F.coalesce("odd_end", F.lit(False)) | (F.col("whole").isNull() & F.col("goes_on").isNotNull()) | F.col("shortened").isNotNull() | F.col("limit").isNotNull()
    found = known.unionByName(out.where(cut_off).select("id", F.lit("truncated").alias("defect")))
    return found.select(F.col("id").alias(id_col), "defect")
