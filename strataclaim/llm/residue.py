"""Problem 9: template residue, filler, error pages and script notices among real content.

1. *Boilerplate.* Normalised lines are counted by host (all documents; a document counts once a line);
   a line in at least ``MIN_SHARE`` of a host's documents is its boilerplate and not this document's,
   unless it is residue itself; of script notices only those with other content beside are a host's.
2. *Suspects.* An automaton of literal signs tells the documents with any sign at all; only these are
   searched. It never passes over one that has evidence.
3. *Evidence.* The residual of a suspect (its text without boilerplate lines) is searched sentence by
   sentence. Code, formulas and quotations are masked first, and a sentence that speaks about markers,
   replies or filler instead of showing them is no evidence.

Evidence is one of ``placeholder``, ``filler``, ``error`` and ``script``. Null, empty and blank texts
have none. A null host has no boilerplate. Very long texts are searched whole. Repeated rows each get
their rows. Extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataclaim.llm.lines import MAX_HELD, digest, held_lines, letters, repeated_lines, repeated_templates
from strataclaim.session import write_cut

MIN_DOCS, MIN_SHARE = 20, 0.2

_NAME = r"[\p{L}_#/][\p{L}\p{N}_ .:/|-]{0,60}"
#: Marks of unfilled slots (fixed patterns of common template languages and of forms).
PLACEHOLDER = regex.compile(
    "|".join(
        (
            rf"\{{\{{[^{{}}\n]{{1,80}}\}}\}}",
            r"\{%[^%\n]{1,120}%\}|<%[^%\n]{1,120}%>|<\?[^?\n]{1,120}\?>",
            r"[$#@]\{[^{}\n]{1,80}\}",
            r"(?<![\\^_}\p{L}\p{N}])\{(?:\d{1,2}|[\p{Ll}_][\p{Ll}\p{N}_.]{1,40}|[\p{Lu}][\p{Lu}\p{N}_]{1,40})\}(?![_^{])",
            rf"<<\s*{_NAME}\s*>>|\[\[\s*[\p{{L}}_][\p{{L}}\p{{N}}_ .-]{{0,60}}\s*\]\]",
            r"%%?[\p{Lu}_]{3,40}%%?|%\([\p{L}_]\w{0,40}\)[sdfr]",
            r"@@?[\p{Lu}_]{3,40}@@?|~[\p{Lu}_]{3,40}(?:~[\p{Lu}_]{2,40})*~|(?<![\p{L}\p{N}_])##?[\p{Lu}_]{3,40}##?(?![\p{L}\p{N}_])",
            r"(?<![\p{L}\p{N}_])__[\p{L}][\p{L}\p{N}_]{1,40}?__(?![\p{L}\p{N}_])|\$[\p{L}]\w{2,40}\$(?!\w)",
            r"\[\s*(?:(?i:insert|your|enter|add|fill|put|replace|todo|tbd|tba|placeholder|xxx+)\b[^\]\n]{0,80}|[^\]\n]{1,60}(?i:goes here|go here|to be added|to be inserted|text here))\s*\]",
            r"\[(?:FIRST |LAST |FULL |AUTHOR |PAPER |COMPANY )?(?:NAME|TITLE|DATE|YEAR|NUMBER|AUTHOR|AUTHORS|JOURNAL|DOI|URL|LINK|ABSTRACT|CITATION|REFERENCE|CONCEPT|VALUE|COHORT|TOPIC|SUBJECT|EMAIL|ADDRESS|COMPANY|INSTITUTION|CITY|COUNTRY|PLACEHOLDER|TEXT|TODO|TBD)\]|\[\p{Lu}{2,}(?:[_ ]\p{Lu}{2,})+\]",
            r"<(?:(?i:insert|your|enter|add|fill)\b[^<>\n]{1,80}|abstract|title|author|authors|name|date|year|journal|doi|value|number|topic|\p{Lu}{3,}(?:[_ ]\p{Lu}{2,})*)>",
        )
    )
)
#: Words of sentences that are about residue (fixed list).
_ABOUT = regex.compile(
    r"(?i)\bstyle (?:markers?|tags?|placeholders?|slots?|syntax)\b|\b(?:tags?|markers?|placeholders?|slots?) (?:are|is|were|was|being|in drafts)\b|\bplaceholder effect\b|\bcount(?:ed)? them\b|\b(?:was|were|is|are) used (?:by|as|in|for)\b|\bcontrol stimul|\bmade up \d|\bpercent of the (?:crawl|sample|pages|records)\b|\bwe (?:crawled|counted|logged)\b|\bthat ask (?:readers|users|visitors|people)\b|\bin the survey tool\b|\bwhich we report\b|\breplaced the paper\b|\bthe (?:term|phrase|word|strings?)\b|\bspeaks? of\b"
)

SCRIPT = regex.compile(
    r"(?i)(?:java\s?script|\bscript(?:s|ing)?\b|\bjs\b|cookies)[^.!?\n]{0,80}?\b(?:required|needed|necessary|disabled|blocked|must be|turned off|switched off|not (?:enabled|supported|available)|off\b|erforderlich|deaktiviert|nécessaires?|désactivés?|requis|necesario|desactivado|richiesto|disattivato)"
    r"|\b(?:enable|enabling|allow|activate|activating|turn on|switch on|needs?|requires?|permit|unblock)\b[^.!?\n]{0,40}?\b(?:java\s?script|scripts?|scripting|cookies)\b"
    r"|\b(?:aktivier\w*|erlauben|einschalten|activer|autoriser|habilit\w*|activ[ae]r?|permit[ae]|attiv\w*|abilit\w*)\b[^.!?\n]{0,40}?\b(?:java\s?script|skripte?|scripts?)\b|\b(?:java\s?script|skripte?)\b[^.!?\n]{0,60}?\b(?:aktivier\w*|activer|habilit\w*|activ[ae]r?|attiv\w*|abilit\w*)\b"
    r"|включите\s+java\s?script|(?:请|需要)[^。\n]{0,10}(?:启用|开启)[^。\n]{0,10}(?:java\s?script|脚本)"
    r"|(?:your )?browser (?:has|does not|doesn['’]t|cannot|can['’]t)[^.!?\n]{0,40}(?:switched off|disabled|turned off|support|run scripts)|\bnoscript\b"
)
ERROR = regex.compile(
    r"(?i)(?:^|[\n.!?:]\s*|\bhttp(?:/\d(?:\.\d)?)?(?: status| error)?\s*|\berror\s*|\berreur\s*|\bfehler\s*)(?:4\d\d|5\d\d)\s*(?:[-–—:|]\s*)?(?:not found|forbidden|unauthori[sz]ed|bad request|gone|internal server error|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|request time-?out|too many requests|error|page|:)"
    r"|\bhttp status \d{3}\b|could not be retrieved\b|\berreur \d{3}\b|\bfehler \d{3}\b|\berror \d{3}\b\s*[:)]"
    r"|\b(?:page|document|file|record|article|paper|entry|resource|item|site)\b[^.!?\n]{0,60}?\b(?:not (?:be )?found|could not be (?:located|found|loaded|displayed|opened)|cannot be (?:found|displayed|opened)|no longer (?:exists?|available)|has moved or|was removed from|has been removed|does not exist|temporarily withdrawn|temporarily unavailable)"
    r"|\bpage not found\b|seite (?:wurde )?nicht gefunden|nicht mehr verfügbar|página no (?:disponible|encontrada)|page (?:introuvable|non trouvée)|pagina non (?:trovata|disponibile)|страница не найдена|页面(?:不存在|未找到)|vous n['’]êtes pas autorisé|vuelva a intentarlo"
    r"|\baccess (?:is |was )?denied\b(?! to \d)|\bdo(?:es)? not have (?:permission|access)\b|\bpermission denied\b|\bnot authori[sz]ed to (?:view|access)"
    r"|\btoo many requests\b|\bservice (?:is )?(?:temporarily )?unavailable\b|\bbad gateway\b|\bgateway time-?out\b|\binternal server error\b(?! in )|\bconnection (?:to \S+ )?(?:timed out|was reset|refused|failed)"
    r"|\bsomething went wrong\b|\bfailed to (?:load|fetch|render|connect|open)\b|\bunable to (?:load|fetch|render|display|open) (?:the|this)\b|^\s*oops\b|\boops!|^\s*loading\s*(?:\.\.\.|…)|\bplease try again (?:later|in)\b|\breload the page\b"
    r"|\byour session (?:has )?(?:expired|timed out)|\blog in again\b|\bprove that you are (?:human|not a robot)|\bverify (?:that )?you are (?:human|not a robot)|\bchecking your browser\b|\bcaptcha\b[^.!?\n]{0,30}(?:complete|solve|below)"
    r"|traceback \(most recent call last\)|^\s*(?:\w+\.)*\w*(?:Error|Exception): |\bat \w+(?:\.\w+)+\(\w+\.java:\d+\)|\bfatal error: |\bstack trace:|\bnullpointerexception\b|\bsegmentation fault\b"
)
_LATIN = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur nunc justo felis massa porta orci tellus quam arcu vitae nisl".split())
FILLER = regex.compile(
    r"(?i)\blorem ipsum\b|\b(?:sample|dummy|filler|placeholder|example) (?:text|copy|content)\b(?: goes here| here|,|\.|\s+for\b|\s+only\b|$)|\b(?:text|content|copy|abstract|summary|description) goes here\b|\bplaceholder (?:copy|text) for\b|\bblindtext\b|\bfülltext\b|\bplatzhaltertext\b|hier steht (?:später|bald|noch)|texte de remplissage|texto de relleno|testo segnaposto|текст-заполнитель|占位"
    r"|\b(?:abstract|keywords?|figures?(?: \d+)?|tables?(?: \d+)?|text|content|summary|details|references) (?:is |are )?(?:to be (?:added|inserted|written|completed)|coming soon|to follow)\b|\breplace (?:it|this|me) with\b|\bto be (?:filled in|written later)\b|\bcoming soon\b\s*[.!]"
    r"|\babstract: (?:pending|tbd|tba|none)\b|\b(?:undefined|null|nan|none)(?: (?:undefined|null|nan|none)){2,}\b|(?:^|\s)(?:test[ ,]+){2,}test\b|\btest(?: \d+)? test\b.{0,30}\bplease ignore\b|\bplease ignore this (?:entry|record|text|message)\b"
    r"|\b(?:asdf|qwer|qwerty|jkl|hjkl|asdfjkl)\w*(?: (?:asdf|qwer|qwerty|jkl|hjkl|zxcv)\w*){2,}|(?:^|\s)(?:x{2,} ){3,}x{2,}|\b(?:bla[ ,]+){2,}bla\b|\b(\p{L}{2,12})(?: \1){4,}\b|(?:^|\s)(?:foo bar baz|abc abc abc)\b"
)
#: Literals, lower-cased; with the patterns below, evidence of any kind has one (fixed values).
SIGNS = tuple(
    "javascript|java script|script|skript|脚本|cookies|browser|http|not found|not be found|no longer|could not|cannot be|does not exist|has moved|been removed|removed from|withdrawn|introuvable|non trouvée|gefunden|verfügbar|disponi|encontrad|trovata|найдена|页面|autoris|vuelva|"
    "denied|permission|not have access|authori|too many|unavailable|gateway|server error|connection to|connection timed|connection was|connection refused|connection failed|went wrong|failed to|unable to|oops|loading|try again|reload|session has|session timed|session expired|log in again|prove that|verify you|verify that you|checking your|captcha|"
    "traceback|error|exception:|nullpointer|stack trace|segmentation|.java:|fehler|erreur|lorem|ipsum|sample text|sample copy|sample content|dummy text|dummy copy|dummy content|filler|placeholder|example text|example copy|example content|go here|goes here|text here|blindtext|fülltext|platzhalter|hier steht|remplissage|relleno|segnaposto|заполнитель|占位|включите|启用|开启|"
    "to be added|to be inserted|to be written|to be completed|to be filled|coming soon|to follow|replace it|replace this|replace me|abstract: |undefined|null null|null nan|null none|nan nan|nan null|nan none|none none|none null|none nan|please ignore|ignore this|asdf|qwer|jkl|xx xx|foo bar|abc abc".split("|")
)
_SLOT = regex.compile(r"\{\{|\{[%#\w]|<[%?<\p{L}]|\[\[|\[\s*\p{L}{2}|[$#@]\{|%%|%[\p{Lu}_]{3}|%\([\p{L}_]|@[\p{Lu}@_]|~[\p{Lu}_]{3}|__\p{L}|#[\p{Lu}_]{3}|\$\p{L}\w{2,40}\$")
_SLOT_MARKS = "{<[@~#$%_"
_REPEATED = regex.compile(r"(?i)\b(\p{L}{2,12})(?: \1){4}")
_CODE_NUMBER = re.compile(r"[45]\d\d\s*(?:[-–—:|]\s*)?(?:not found|forbidden|unauth|bad |gone|internal|service|gateway|request|too many|error|page|:)")
_JS = regex.compile(r"\bjs\b")
_TWICE = re.compile(r"(test|bla)[ ,]+\1")
#: Letters that patterns without case take for others, though lower-casing doesn't.
_FOLDS = (("ſ", "s"), ("ı", "i"), ("i\u0307", "i"))
#: Any character that masks a part of a sentence.
_MASKS = "`\"$\\«“"
_AUTOMATON = None


def _has_sign(text: str) -> bool:
    """Whether a text has a sign of any kind of evidence."""
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = ahocorasick.Automaton()
        for w in SIGNS:
            _AUTOMATON.add_word(w, w)
        _AUTOMATON.make_automaton()
    low = text.lower()
    if not low.isascii():
        for c, plain in _FOLDS:
            low = low.replace(c, plain)
    if next(_AUTOMATON.iter(low), None) is not None or _CODE_NUMBER.search(low):
        return True
    if any(c in text for c in _SLOT_MARKS) and _SLOT.search(text):
        return True
    if "js" in low and _JS.search(low) or ("test" in low or "bla" in low) and _TWICE.search(low):
        return True
    # a sentence is Latin filler from six such words on
    return sum(map(_LATIN.__contains__, low.replace(",", " ").replace(".", " ").split())) >= 6 or bool(_REPEATED.search(text))


def is_suspect(text: str) -> bool:
    """Whether a text may hold evidence; never False where ``evidence`` finds any."""
    if _has_sign(text):
        return True
    # what is masked may leave a sign of the words around it
    return any(c in text for c in _MASKS) and any(_has_sign(said) for _, said in _sentences(text))


_CODE = regex.compile(r"`[^`\n]{1,200}`|\$[^$\n]{0,120}[\\_^=][^$\n]{0,120}\$(?!\w)|\\[a-zA-Z]+(?:\{[^{}\n]*\}|\[[^\]\n]*\])*(?:[_^](?:\{[^{}\n]*\}|\w))*")
_QUOTE = regex.compile(r"«[^»\n]*»|“[^”\n]*”|(?<![\w=])\"[^\"\n]{1,200}\"")
_WORD = regex.compile(r"[\p{L}\p{N}]")
_SENTENCE = regex.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])|\n+")
#: A template's slot in dollar signs isn't a formula.
_DOLLAR_SLOT = regex.compile(r"\$[\p{L}]\w{2,40}\$(?!\w)")


def _sentences(text: str) -> Iterator[tuple[str, str]]:
    """The sentences of a text with code masked, and each without its quotations."""
    kept = _DOLLAR_SLOT.sub(lambda m: f"{{{{{m.group()[1:-1]}}}}}", text)
    for s in _SENTENCE.split(_CODE.sub(" ", kept)):
        if s := s.strip():
            yield s, _QUOTE.sub(" ", s)


def evidence(text: str | None) -> list[tuple[str, str]]:
    """(kind, sentence) of each sentence that is residue."""
    if not text or not text.strip():
        return []
    out = []
    for s, said in _sentences(text):
        if _ABOUT.search(s):
            continue
        if PLACEHOLDER.search(said):
            out.append(("placeholder", s))
        elif SCRIPT.search(said):
            out.append(("script", s))
        elif ERROR.search(said):
            out.append(("error", s))
        elif FILLER.search(said) or _is_latin(said):
            out.append(("filler", s))
    return out


def _is_latin(sentence: str) -> bool:
    ws = sentence.lower().replace(",", " ").rstrip(".").split()
    return len(ws) >= 8 and sum(w in _LATIN for w in ws) > 0.7 * len(ws)


def without_boilerplate(text: str, drops: set[int]) -> str:
    """A text without those of the lines numbered ``drops`` that are no evidence.

    A script notice goes where other lines have content (it is the host's footer), not where it is all there is.
    """
    lines = [(k not in drops, x, {kind for kind, _ in evidence(x)}) for k, x in enumerate(text.split("\n"), 1)]
    alone = not any(not kinds and _WORD.search(x) for _, x, kinds in lines)
    return "\n".join(x for own, x, kinds in lines if own or kinds - {"script"} or kinds and alone)


def residue(df: DataFrame, id_col: str, host_col: str, text_col: str, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, max_held: int = MAX_HELD) -> DataFrame:
    """``(id_col, kind, sentence)`` of all evidence; a document without any has no row.

    Boilerplate lines are few (each covers ``min_share`` of a host); up to ``max_held`` of them are held by
    every task, so documents are sifted, cleaned and searched where they are. Beyond that the suspects
    are joined with the numbers of their lines.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    hot = write_cut(repeated_templates(src, "host", "text", min_docs, min_share).select("source", "letters"))
    held = held_lines(df.sparkSession, hot, max_held)

    def drops_of(host: str | None, text: str) -> set[int]:
        wanted = held.value.get(host) if held is not None else None
        return {n for n, line in enumerate(text.split("\n"), 1) if (spelt := letters(line)) and digest(spelt) in wanted} if wanted else set()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for k, text in enumerate(b.column(2)):
                t = text.as_py()
                if not is_suspect(t):
                    continue
                own = drops_of(b.column(1)[k].as_py(), t) if held is not None else set(b.column(3)[k].as_py() or ())
                i = b.column(0)[k].as_py()
                found += [(i, kind, s) for kind, s in evidence(without_boilerplate(t, own) if own else t)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (b.schema.field(0).type, pa.string(), pa.string()))], names=["id", "kind", "sentence"])

    rows = src.where("text is not null")
    if held is None:
        # lines are numbered by row, as rows may share an id
        keyed = rows.withColumn("row", F.xxhash64("id", "host", "text"))
        drops = repeated_lines(keyed, "row", "host", "text", min_docs, min_share, max_held).groupBy("row").agg(F.collect_set("line_no").alias("drops"))
        rows = keyed.join(drops, "row", "left").select("id", "host", "text", "drops")
    return rows.mapInArrow(search, f"id {id_type}, kind string, sentence string").withColumnRenamed("id", id_col)
