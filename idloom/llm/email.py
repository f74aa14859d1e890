"""The text newly written by the sender of each mail.

Bodies are segmented into paragraphs and these into blocks of lines of one form; gradient-boosted trees classify the
blocks by contact density, quote depth, sender frequency (in how many of the sender's mails a line recurs, and how often below a closing), ancestor
overlap (word shingles shared with the mails that it answers or refers to) and the place among markers. The trees are fitted on a bounded
sample of mails whose blocks are labelled by the reading rules in ``label``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom.functions.payload import get_text, payload
from idloom.operators.skew import join_label
from idloom.llm.trees import Trees, fit
from idloom.storage import Table, cut

#: Mails whose blocks the trees are fitted on, at most.
TRAIN_MAILS = 2500
#: Mails read at once by a task.
SLICE_MAILS = 500
#: Words of an overlap shingle.
SHINGLE = 5

# Words by which mail programs and writers mark quotes, forwards, closings, devices and notices.
WROTE = r"(?:wrote|writes|schrieb|schreibt|a écrit|écrit|escribió|escribe|ha scritto|escreveu)"
MONTH = r"(?:jan|feb|f[ée]v|m[aä]r|apr|avr|abr|ma[iy]|jun|juin|jul|juil|aug|ao[uû]t|ago|sep|o[ck]t|nov|de[cz]|d[ée]c|ene)"
LABELS = r"(?:from|to|cc|bcc|sent|date|subject|reply-to|von|an|gesendet|datum|betreff|de|à|a|envoyé|objet|para|enviado|fecha|asunto|da|inviato|oggetto)"
FROM = r"(?:from|von|de|da)"
CLOSINGS = (
    r"(?:(?:all the |with )?(?:best|kind|kindest|warm|warmest)(?: regards| wishes)?|regards|cheers|(?:many )?thanks(?: again| a lot| so much| in advance)?|thank you|"
    r"sincerely(?: yours)?|yours(?: sincerely| truly| faithfully)?|talk soon|speak soon|see you(?: soon)?|take care|warmly|respectfully|greetings|"
    r"mit (?:freundlichen|besten|herzlichen) grüßen|(?:viele|schöne|beste|liebe|herzliche|freundliche) grüße|(?:lieben|schönen|besten) gruß|gruß|grüße|"
    r"(?:vielen |besten |herzlichen )?dank(?: im voraus)?|danke|bis (?:bald|dann|morgen)|mfg|vg|lg|hochachtungsvoll|"
    r"(?:bien )?cordialement|bien à (?:vous|toi)|(?:un grand )?merci(?: d'avance| beaucoup| bien| encore)?|(?:meilleures |sincères )?salutations|à (?:bientôt|plus|demain)|amicalement|"
    r"(?:un |muchos )?(?:cordial )?saludos?(?: cordiales?)?|atentamente|(?:muchas )?gracias(?: de antemano)?|un abrazo|hasta (?:pronto|luego|mañana)|"
    r"cordiali saluti|saluti|grazie|atenciosamente|obrigad[oa])"
)
DEVICE_STARTS = ("sent from ", "sent via ", "get the ", "gesendet von ", "gesendet mit ", "von meinem ", "envoyé de ", "envoyé depuis ", "enviado desde ", "enviado con ", "inviato da ", "obtén ", "obtener ", "obtenir ", "téléchargez ", "descarga ", "descargue ", "holen sie sich ", "hol dir ")
DEVICE_WORDS = ("typos", "tippfehler", "pardon pour les fautes", "erratas", "perdón por los errores", "disculpe los errores", "disculpa los errores")
# Forms of legal, security and list notices as mail systems and companies commonly put them.
NOTICE_FORMS = (
    r"^caution:", r"^\[?(?:external|extern[eo]?|ext)\]?(?::|\]|$)", r"\b(?:came|originated) from outside\b", r"\bconfidential(?:ity)?\b.{0,40}\b(?:notice|information|intended|content|e-?mail|message)", r"\b(?:intended|named|only for the|meant only for) .{0,24}(?:recipient|addressee)",
    r"\b(?:in error|by mistake)\b.{0,40}\b(?:tell|notify|inform|contact|delete|remove|destroy)", r"\b(?:delete|remove|destroy) (?:it|this|all|every|any) (?:and )?.{0,16}cop(?:y|ies)\b", r"\b(?:privileged|protected) (?:material|information)\b", r"\bnot (?:permitted|allowed) without (?:prior |written |our )*(?:consent|permission)\b",
    r"\bviews? (?:or opinions? )?(?:expressed|stated)\b", r"\b(?:no |not )?(?:legally )?binding (?:agreement|contract)\b", r"\bfree (?:of|from) (?:faults|errors|viruses|virus|malware)\b", r"\b(?:scans?|scanned) .{0,24}(?:mail|messages?|viruses)\b.{0,60}\b(?:cannot|can't|no liability|not liable|promise|guarantee|warrant)",
    r"\b(?:to|can|may|please) unsubscribe\b", r"\bunsubscribe (?:from|here|at any time|by)\b", r"\bclick .{0,24}\bunsubscribe\b", r"\b(?:leave|follow|get off) (?:the|this|our) (?:mailing )?list\b", r"\byou (?:receive|received|are receiving|get) this (?:e-?mail|mail|message|note|newsletter)\b", r"\bconsider the environment\b", r"\bregistered (?:office|in england)\b",
    r"\bvertraulich(?:keit|e)\b.{0,40}\b(?:information|nachricht|inhalt|hinweis|angaben)", r"\b(?:genannten|bestimmten|vorgesehenen) empfänger\b", r"\bgeschützte (?:angaben|informationen|inhalte)\b", r"\birrtümlich (?:erhalten|zugestellt)\b", r"\b(?:löschen|vernichten) sie .{0,16}(?:alle|sämtliche) kopien\b", r"\balle kopien\b", r"geschäftsführ(?:ung|er):", r"\bsitz der gesellschaft\b", r"\bhandelsregister\b", r"\bstammt (?:nicht aus|von außerhalb)\b.{0,24}\bnetz",
    r"\bconfidentialité\b", r"\b(?:personnes? (?:nommées?|désignées?)|destinataires? (?:nommés?|désignés?|prévus?))\b", r"\bdonnées protégées\b", r"\breçu par erreur\b", r"\bmerci de (?:le|la|les) supprimer\b", r"\bvient de l'extérieur\b", r"\bmentions légales\b", r"\bdésabonner\b",
    r"\bconfidencialidad\b", r"\b(?:personas? indicadas?|destinatarios? (?:indicados?|previstos?))\b", r"\bdatos protegidos\b", r"\brecib(?:ió|ido) por error\b", r"\bbórrel[oa]s?\b", r"\bprocede de fuera\b", r"\bregistro mercantil\b", r"\baviso legal\b", r"\bdarse de baja\b",
)
#: A line said in at least so many mails, at least this share of them below a closing or a rule, belongs to a footer.
FOOTER_MAILS, FOOTER_SHARE = 3, 0.75

_NOTICE = re.compile("|".join(NOTICE_FORMS))
_PREFIX = re.compile(r"^[ \t]*((?:(?:>|\||[A-Z]{1,3}>)[ \t]?)+)")
_MARK = re.compile(r"[>|]")
_ATTR = re.compile(
    rf"{WROTE}\s*:?$|{WROTE} (?:on|am|le|el|at|a las|um)\b(?:[^.!?]|\.(?=\d))*\d(?:[^.!?]|\.(?=\d))*:?$|\d.*\b{WROTE}\b.{{0,120}}:$|^[^.!?]{{0,12}}\d.*\b(?:gmt|utc|cet|cest|est|pst)\b.*:$",
    re.I,
)
_HEAD = re.compile(r"^(?:(?:on|at|am|le|el|il|em)\b.*\d|.*<\S+@|\S*\d.*\b(?:gmt|utc)\b|[^\s.!?]+(?: [^\s.!?]+){0,3} (?:wrote|writes|schrieb|a écrit|escribió)|[^\d.!?]{0,12}\d.*\b(?:gmt|utc)\b)", re.I)
_OPEN_HEAD = re.compile(r"^(?:on|at|am|le|el)\b[^.!?]*\d[^.!?]*$|<\S+@\S+>(?: wrote(?: on)?)?$|\b(?:gmt|utc)\b", re.I)
_TAIL = re.compile(r"^(?:on|am|le|el|at|um|à|a las)?\b.{0,40}\d.{0,12}:$", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_DATEISH = re.compile(rf"\d{{1,4}}[./-]\d{{1,2}}[./-]\d{{1,4}}|\b{MONTH}\w*\.? \d|\d\.? {MONTH}|\d:\d\d|<\S+@\S+>|@|\byou {WROTE}", re.I)
_ORIG = re.compile(
    r"^-{2,} ?.*\b(?:original|originale|origine|forwarded|weitergeleitete?n?|ursprüngliche|reenviado|transféré|message|nachricht|mensaje|messaggio)\b.*-{2,}$"
    r"|^(?:begin forwarded message|anfang der weitergeleiteten nachricht|début du message (?:transféré|réexpédié)|inicio del mensaje reenviado|comienzo del mensaje reenviado)\s*:$",
    re.I,
)
_LABEL = re.compile(rf"^\*?{LABELS}\s?:\*?(?:\s|$)", re.I)
_FROM = re.compile(rf"^\*?{FROM}\s?:\*?\s", re.I)
_RULE = re.compile(r"^(?:[-_*=~#+.–—] ?){2,}$")
_CLOSE = re.compile(rf"^{CLOSINGS}\s*[,.!]?$", re.I)
_CONTACT = re.compile(r"\+?\d[\d ()/.-]{6,}\d|\bext\.? ?\d+|https?://\S+|www\.\S+|\S+@\S+\.\S+")
_CONTACT_LINE = re.compile(r"^(?:(?:t|tel|phone|mobile|m|fax|tél|mobil|móvil)\.?:?\s*)?(?:\+?\d[\d ()/.-]{6,}\d(?:\s*ext\.? ?\d+)?|https?://\S+|www\.\S+|<?\S+@\S+\.\S+>?)$", re.I)
_PIPES = re.compile(r"^[^|]+(?: \| [^|]+)+$")
_WORD = re.compile(r"\w+")
_DIGIT = re.compile(r"\d")
_NAME = re.compile(r"^[A-ZÀ-Þ][\w'’.-]*(?: (?:of|de|für|du|der|und|et|y|[A-ZÀ-Þ&][\w'’.-]*)){0,4}$")
_PS = re.compile(r"^(?:p\.? ?s\.?|p\.? ?d\.?|n\.? ?b\.?|ps)\b\s*:?", re.I)
_GREET = re.compile(r"^(?i:hi|hello|hey|dear|good (?:morning|afternoon|evening)|hallo|guten|liebe[rs]?|sehr geehrte|moin|bonjour|bonsoir|salut|cher|chère|hola|buenos|buenas|estimad[oa]s?|querid[oa])\b.{0,50}[,!:]?$|^[A-ZÀ-Þ][\w'’-]+(?: [A-ZÀ-Þ][\w'’-]+)? [-–]$")
_ELIDED = re.compile(r"^\[?(?:\.\.\.|…)\]?$")
_END = re.compile(r"[.!?…:]['\")\]]*$")

FEATURES = (
    "depth", "indented", "lone_quote", "lines", "words", "contact_density", "labels", "attribution", "original", "rule", "closing", "device", "notice", "names", "pipes", "elided",
    "after_history", "after_bare_attribution", "in_signature", "first", "from_end", "sender_frequency", "corpus_frequency", "footer_share", "overlap", "has_ancestor", "sentence", "greeting", "postscript", "quote_before", "long_line", "answer_place", "second_greeting",
)


_VERBS = ("wrote", "writes", "schr", "écri", "escrib", "ha scritto", "escreveu", "gmt", "utc", "cet", "cest", "est", "pst")


def _verb(text: str) -> bool:
    low = text.lower()
    return any(v in low for v in _VERBS)


#: Parts of words of which every notice form holds one; most lines hold none.
_NOTICE_PARTS = ahocorasick.Automaton()
for _part in (
    "caution:", "extern", "[ext", "from outside", "confiden", "recipient", "addressee", "in error", "by mistake", "copy", "copies", "protected ", "privileged", "permitted without", "allowed without", "views ", "view ", "opinion", "binding", "free of", "free from", "scan", "unsubscribe",
    "the list", "this list", "our list", "the mailing", "this mailing", "our mailing", "you receive", "you are receiving", "you get this", "consider the", "registered", "vertraulich", "empfänger", "geschützte", "irrtümlich", "kopien", "geschäftsführ", "der gesellschaft", "handelsregister", "stammt",
    "personne", "destinat", "données protégées", "par erreur", "supprimer", "extérieur", "mentions légales", "désabonner", "personas indicada", "persona indicada", "datos protegidos", "por error", "bórrel", "procede de", "registro mercantil", "aviso legal", "darse de",
):
    _NOTICE_PARTS.add_word(_part, True)
_NOTICE_PARTS.make_automaton()


def _notice(low: str) -> bool:
    return next(_NOTICE_PARTS.iter(low), None) is not None and _NOTICE.search(low) is not None


def _device(low: str) -> bool:
    return low.startswith(DEVICE_STARTS) or any(x in low for x in DEVICE_WORDS)


def _contacts(text: str) -> list[str]:
    return _CONTACT.findall(text) if "@" in text or "www." in text or "http" in text or _DIGIT.search(text) else []


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def line_key(text: str) -> int:
    """The hash by which an unquoted line is counted: Spark's ``xxhash64`` of it trimmed and in lower case, so that a line
    of any length costs eight bytes."""
    h = xxhash.xxh64_intdigest(text.strip(" \t\n\r\f\v").lower().encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


class Line:
    __slots__ = ("no", "raw", "text", "depth", "indent", "kind", "cover", "block", "freq")

    def __init__(self, no: int, raw: str):
        self.no, self.raw = no, raw
        m = _PREFIX.match(raw)
        # A bar is a quote mark only at the very start of the line and before a blank; "a | b" is text.
        self.depth = len(_MARK.findall(m.group(1))) if m else 0
        body = raw[m.end() :] if m else raw
        self.indent = not m and (raw.startswith("    ") or raw.startswith("\t"))
        self.text = body.strip()
        self.kind, self.cover, self.block, self.freq = "", 0.0, -1, (0.0, 0.0, 0.0)

    def footer(self) -> bool:
        """Whether the line is said again and again, and nearly always below a closing."""
        return self.freq[2] >= FOOTER_SHARE and len(self.text.split()) >= 3


def _kinds(lines: list[Line]) -> None:
    """Sets the kind of each line by its form; wrapped attributions and header blocks look at their neighbours."""
    for x in lines:
        x.kind = "text"
    # A line within a marked quote is quoted whatever its form; only one that stands alone is read.
    full = [x for x in lines if x.text and (not x.depth or not (x.no > 1 and lines[x.no - 2].depth) and not (x.no < len(lines) and lines[x.no].depth))]
    n = len(full)
    for x in full:
        t = x.text
        low = t.lower()
        if _ELIDED.match(t):
            x.kind = "elided"
        elif _RULE.match(t):
            x.kind = "rule"
        elif _ORIG.match(t):
            x.kind = "original"
        elif len(t) < 48 and _CLOSE.match(t):
            x.kind = "closing"
        elif (len(t) < 90 and _CONTACT_LINE.match(t)) or (" | " in t and len(t) < 160 and _PIPES.match(t) and (_contacts(t) or all(_NAME.match(p.strip()) for p in t.split("|")))):
            x.kind = "contact"
        elif len(t) < 120 and not t.endswith(".") and _device(low):
            x.kind = "device"
        elif _notice(low):
            x.kind = "notice"
    # Header blocks: at least two labelled lines together, one of them a sender's, or right after a forward's marker.
    i = 0
    while i < n:
        if full[i].kind in ("text", "contact") and _LABEL.match(full[i].text):
            j = i
            while j < n and _LABEL.match(full[j].text) and full[j].depth == full[i].depth:
                j += 1
            block = full[i:j]
            lead = i > 0 and full[i - 1].kind in ("original", "rule")
            ok = (j - i >= 2 and any(_FROM.match(x.text) for x in block)) or (lead and (_FROM.match(block[0].text) is not None)) or (j == n and _FROM.match(block[0].text) and "@" in block[0].text)
            if ok:
                for x in block:
                    x.kind = "label"
                # A subject wrapped to the next line is told by no form; it stays with the history that follows.
            i = j
        else:
            i += 1
    for i, x in enumerate(full):
        if x.kind not in ("text", "contact", "closing", "notice"):
            continue
        joined = x.text
        if joined.endswith(".") or not _verb(joined) and not full[min(i + 1, n - 1)].text.startswith("<") and not _HEAD.match(joined):
            continue
        if _verb(joined) and _ATTR.search(joined) and (_DATEISH.search(joined) or len(joined.split()) <= 5):
            x.kind = "attribution"
            if not joined.endswith(":") and i + 1 < n and full[i + 1].no == x.no + 1 and _TAIL.match(full[i + 1].text):
                full[i + 1].kind = "attribution"
            continue
        follows = i + 1 < n and full[i + 1].no == x.no + 1 and full[i + 1].text.startswith("<") and _NAME.match(joined) is not None
        if not follows and not _HEAD.match(joined):
            continue
        if i == n - 1 and not x.depth and _OPEN_HEAD.search(joined) and not _END.search(joined):
            x.kind = "attribution"  # the body was cut within it
            continue
        for k in (1, 2):
            if i + k >= n or full[i + k].no != x.no + k or full[i + k].depth != x.depth or _END.search(full[i + k - 1].text) or len(joined) > 160:
                break
            joined += " " + full[i + k].text
            if _verb(joined) and _ATTR.search(joined) and _DATEISH.search(joined) and len(joined) < 240:
                for y in full[i : i + k + 1]:
                    y.kind = "attribution"
                break


def _footers(lines: list[Line]) -> None:
    """What is said again and again below closings is a footer where it stands below one."""
    below = False
    for x in lines:
        below = below or x.kind in ("closing", "rule")
        if below and x.kind == "text" and x.footer() and not _PS.match(x.text):
            x.kind = "notice"


def _remnants(lines: list[Line]) -> None:
    """Gives a line that broke off a marked quote when it was wrapped anew the depth of that quote: it stands between two
    quoted lines, or goes on below one, within a sentence of theirs."""
    for a, x in zip(lines, lines[1:], strict=False):
        if not x.text or x.depth or x.indent or not a.depth or not a.text:
            continue
        after = lines[x.no] if x.no < len(lines) else None
        quoted = after is not None and after.depth > 0
        unfinished = not _END.search(a.text)
        goes_on = unfinished and (quoted or x.text[0].islower()) or quoted and not _END.search(x.text) and after.text[:1].islower()
        if goes_on:
            x.depth = a.depth


def _notices(lines: list[Line]) -> None:
    """Wrapped notices: a line most of whose words lie in notice sentences of its paragraph is one, any other is none."""
    at = 0
    while at < len(lines):
        end = at
        while end < len(lines) and lines[end].text and lines[end].depth == lines[at].depth:
            end += 1
        part = [x for x in lines[at:end] if x.kind in ("text", "notice")] if not lines[at].depth else []
        if len(part) > 1 and _notice(" ".join(x.text for x in part).lower()):
            owner = [x for x in part for _ in x.text.split()]
            # What every mail says below its closing stays a notice, whatever its sentences are.
            hits = {x.no: len(x.text.split()) if x.kind == "notice" and not _notice(x.text.lower()) else 0 for x in part}
            k = 0
            for sentence in _SENTENCE.split(" ".join(x.text for x in part)):
                m = len(sentence.split())
                if _notice(sentence.lower()):
                    for x in owner[k : k + m]:
                        hits[x.no] += 1
                k += m
            for x in part:
                x.kind = "notice" if 2 * hits[x.no] > len(x.text.split()) else "text"
        at = max(end, at + 1)


def _shingles(texts: list[str]) -> tuple[set[tuple], set[str]]:
    """The shingles of some texts, and their lines that are shorter than one."""
    grams, short = set(), set()
    for text in texts:
        seq: list[str] = []
        for raw in text.split("\n"):
            w = words(_PREFIX.sub("", raw))
            seq += w
            if len(w) < SHINGLE:
                short.add(" ".join(w))
        grams.update(_grams(seq))
    return grams, short


def _overlap(lines: list[Line], ancestor: str | None, others: list[str]) -> bool:
    """Sets each line's share of words that lie in a shingle of an ancestor; shorter runs must be a whole line of one.

    Mails other than the one answered count from the first quote, attribution or forward on: before it nothing of theirs
    is quoted, and with many of them some line is alike by chance.
    """
    if not ancestor and not others:
        return False
    near = _shingles([ancestor] if ancestor else [])
    far = _shingles(others)
    start = next((x.no for x in lines if x.depth or x.kind in ("attribution", "original", "label")), len(lines) + 1)
    seq, owner = [], []
    for x in lines:
        if not x.text or (x.depth and x.no > 1 and lines[x.no - 2].depth):
            continue
        w = words(x.text)
        if len(w) < SHINGLE:
            text = " ".join(w)
            x.cover = 1.0 if w and (text in near[1] or x.no >= start and text in far[1]) else 0.0
        seq += w
        owner += [x] * len(w)
    hit = [False] * len(seq)
    for i, g in enumerate(_grams(seq)):
        if g in near[0] or owner[i].no >= start and g in far[0]:
            hit[i : i + SHINGLE] = [True] * SHINGLE
    at = 0
    while at < len(owner):
        x, end = owner[at], at
        while end < len(owner) and owner[end] is x:
            end += 1
        if end - at >= SHINGLE:
            x.cover = sum(hit[at:end]) / (end - at)
        at = end
    return True


def _grams(seq: list[str]) -> Iterator[tuple]:
    return zip(*(seq[i:] for i in range(SHINGLE)), strict=False)


def _lines(body: str) -> list[Line]:
    lines = [Line(i + 1, x.rstrip("\r")) for i, x in enumerate(body.split("\n"))]
    _remnants(lines)
    return lines


#: The kinds of lines, by the numbers under which a reading keeps them.
KINDS = ("text", "elided", "rule", "original", "closing", "contact", "device", "notice", "label", "attribution")
_KIND_NO = {k: i for i, k in enumerate(KINDS)}


class Reading:
    """The kind of each line of a body by its form and its overlap with earlier mails: all that is told without the
    lines' frequency, so that it is worked out once, before the lines are counted."""

    __slots__ = ("kinds", "covers", "known", "compared")

    def __init__(self, kinds: bytes, covers: bytes, known: bool, compared: bool):
        self.kinds, self.covers, self.known, self.compared = kinds, covers, known, compared

    @classmethod
    def of(cls, lines: list[Line], ancestor: str | None, others: list[str]) -> Reading:
        """Also sets the lines' kinds and overlap."""
        _kinds(lines)
        compared = _overlap(lines, ancestor, others)
        covers = np.array([x.cover for x in lines]).tobytes() if any(x.cover for x in lines) else b""
        return cls(bytes(_KIND_NO[x.kind] for x in lines), covers, bool(ancestor), compared)

    def put(self, lines: list[Line]) -> None:
        for x, k in zip(lines, self.kinds, strict=True):
            x.kind = KINDS[k]
        if self.covers:
            for x, c in zip(lines, np.frombuffer(self.covers).tolist(), strict=True):
                x.cover = c


def said_lines(lines: list[Line], compared: bool) -> dict[int, int]:
    """Hash of each line of the whole body that its sender says -> 1 if it only stands below a closing phrase or a rule of
    theirs, else 0.

    Answers, signatures and footers between and below quotes count like those above. Quotes by marks or
    indent, lines that broke off one, their introducing lines and all below a forward's marker or header block are other
    mails' text: it counts there. Below an attribution without marks a line that lies in a mail referred to isn't the sender's.
    """
    out: dict[int, int] = {}
    bare = below = copied = quoted = False
    # Whether the next line of a shingle's length is new: asked only beside other mails.
    fresh, new = [False] * len(lines), False
    for x in reversed(lines) if compared else ():
        fresh[x.no - 1] = new
        if not x.depth and len(x.text) > SHINGLE and len(words(x.text)) >= SHINGLE:
            new = x.cover < 0.5
    for i, x in enumerate(lines):
        if x.depth:
            quoted = quoted or any(y.depth for y in (*lines[max(i - 1, 0) : i], *lines[i + 1 : i + 2]))
            continue
        if not x.text or x.indent and quoted:
            continue
        if not x.indent and x.kind in ("original", "label"):
            break
        if x.kind == "attribution":
            quoted = True
            after = next((lines[k] for k in range(x.no, len(lines)) if lines[k].text and (lines[k].depth or lines[k].kind != "attribution")), None)
            if not x.indent and after is not None and not after.depth and not after.indent and after.kind not in ("original", "label"):
                bare = copied = compared
            continue
        if bare:
            # Short lines are alike in all mails: they go with the longer line above, a greeting with the one below.
            if len(words(x.text)) >= SHINGLE:
                copied = x.cover >= 0.5
            if copied and x.cover >= 0.5 and not (_GREET.match(x.text) and fresh[i]):
                continue
        key = line_key(x.raw)
        out[key] = min(int(below), out.get(key, 1))
        below = below or x.kind in ("closing", "rule")
    return out


class Mail:
    """A body's lines, blocks and their features.

    ``ancestor`` is the body of the mail answered, ``others`` are those of further mails referred to. Overlap counts with
    all of them; that a text is in none of them tells something only where the mail answered is known. ``reading``: what
    an earlier reading of the same body and mails found.
    """

    def __init__(self, body: str, ancestor: str | None = None, sender: str | None = None, frequency: dict[int, tuple[float, float, float]] | None = None, others: list[str] | None = None, reading: Reading | None = None):
        self.lines = _lines(body)
        if reading is None:
            reading = Reading.of(self.lines, ancestor, others or [])
        else:
            reading.put(self.lines)
        if frequency:
            for x in self.lines:
                if x.text and not x.depth:
                    x.freq = frequency.get(line_key(x.raw), x.freq)
            _footers(self.lines)
        _notices(self.lines)
        self.known, self.compared = reading.known, reading.compared
        self.sender = {w for w in words(sender or "") if len(w) > 1}
        self.blocks: list[list[Line]] = []
        self._segment()
        self._place()

    def _form(self, x: Line) -> tuple:
        return (x.depth > 0, x.depth, x.indent, x.kind, self.compared and x.depth == 0 and len(x.text.split()) >= SHINGLE and x.cover >= 0.8)

    def _segment(self) -> None:
        before = None
        for x in self.lines:
            if not x.text:
                before = None
                continue
            form = self._form(x)
            if before is None or form != before:
                self.blocks.append([])
            before = form
            x.block = len(self.blocks) - 1
            self.blocks[-1].append(x)

    def _is_name(self, x: Line) -> bool:
        if len(x.text) > 60:
            return False
        w = words(x.text)
        return bool(w) and len(w) <= 5 and not _END.search(x.text) and (_NAME.match(x.text) is not None or bool(self.sender.intersection(w)) and len(w) <= 3)

    def _place(self) -> None:
        """States along the mail: within unmarked history, after an attribution without marks, within a signature."""
        b = self.blocks
        n = len(b)
        self.history, self.bare, self.signature, self.quoted_before, self.lone, self.answer, self.second = ([False] * n for _ in range(7))
        self.greeting = [bool(_GREET.match(block[0].text)) and len(block[0].text) < 60 for block in b]
        history = bare = signature = quoted = closed = own_seen = greeted = False
        for i, block in enumerate(b):
            x = block[0]
            gap = i > 0 and x.no - b[i - 1][-1].no > 1
            self.quoted_before[i] = quoted
            if x.depth:
                alone = len(block) == 1 and not (i > 0 and b[i - 1][-1].depth and not gap) and not (i + 1 < n and b[i + 1][0].depth and b[i + 1][0].no == x.no + 1)
                near = self.lines[x.no - 2].raw if x.no > 1 else ""
                after = self.lines[x.no].raw if x.no < len(self.lines) else ""
                self.lone[i] = alone and not _PREFIX.match(near) and not _PREFIX.match(after)
                if not self.lone[i]:
                    quoted, signature = True, False
            elif not x.indent:
                names = all(self._is_name(y) for y in block)
                if x.kind in ("original", "label"):
                    history = True
                elif x.kind == "attribution":
                    nxt = next((y for c in b[i + 1 :] for y in c if y.kind != "attribution"), None)
                    if nxt is not None and not nxt.depth and not nxt.indent and nxt.kind not in ("original", "label"):
                        bare, closed = True, False
                    quoted = True
                    signature = False
                elif x.kind in ("closing", "rule", "contact", "device", "notice"):
                    signature = True
                    closed = closed or bare
                elif x.kind == "text":
                    self.second[i] = self.greeting[i] and greeted and own_seen and not history
                    if self.second[i] and not bare:
                        bare, closed, quoted, signature = True, False, True, False
                    greeted = greeted or self.greeting[i]
                    # An answer below a bare quote follows the signature of the quoted mail.
                    self.answer[i] = bare and closed and not own_seen and not names
                    if gap and signature and not names:
                        signature = False
                    elif not signature and names and i > 0 and not self.greeting[i]:
                        signature = True
                    own_seen = own_seen or not (quoted or history or bare or names or self.greeting[i])
            self.history[i], self.bare[i], self.signature[i] = history, bare, signature

    def features(self) -> np.ndarray:
        b = self.blocks
        out = []
        for i, block in enumerate(b):
            x = block[0]
            n = len(block)
            if x.depth and not self.lone[i]:
                row = [0.0] * len(FEATURES)
                row[0], row[3], row[20], row[25], row[29] = x.depth, n, len(b) - i, self.known, self.quoted_before[i]
                out.append(row)
                continue
            toks = sum(len(y.text.split()) for y in block)
            kind = dict.fromkeys(("label", "attribution", "original", "rule", "closing", "device", "notice", "contact", "elided"), 0)
            kind[x.kind] = 1
            freq = [y.freq for y in block]
            out.append((
                x.depth, x.indent, self.lone[i], n, toks / n, sum(len(_contacts(y.text)) + y.text.count(" | ") for y in block) / max(toks, 1),
                kind["label"], kind["attribution"], kind["original"], kind["rule"], kind["closing"], kind["device"], kind["notice"],
                sum(map(self._is_name, block)) / n, kind["contact"], kind["elided"],
                self.history[i], self.bare[i], self.signature[i], i == 0, len(b) - i,
                sum(f[0] for f in freq) / n, sum(f[1] for f in freq) / n, sum(f[2] for f in freq) / n, self._cover(block), self.known,
                bool(_END.search(block[-1].text)), self.greeting[i], bool(_PS.match(x.text)), self.quoted_before[i], max(len(y.text) for y in block), self.answer[i], self.second[i],
            ))
        return np.array(out, dtype=np.float64).reshape(len(b), len(FEATURES))

    def _cover(self, block: list[Line]) -> float:
        if not self.compared:
            return 0.0
        some = [y.cover for y in block if len(y.text.split()) >= SHINGLE] or [y.cover for y in block]
        return sum(some) / len(some)

    def label(self) -> np.ndarray:
        """1 for blocks that the reading rules take for the sender's own, else 0."""
        out = np.zeros(len(self.blocks))
        for i, block in enumerate(self.blocks):
            x = block[0]
            long_lines = [y for y in block if len(y.text.split()) >= SHINGLE]
            cover = sum(y.cover for y in long_lines) / len(long_lines) if long_lines else 0.0
            if x.depth:
                own = self.lone[i] and cover < 0.5 and (not self.quoted_before[i] or self.known and bool(long_lines)) and x.kind == "text"
            elif x.indent and self.quoted_before[i]:
                own = False
            elif self.history[i] or x.kind in ("original", "label", "attribution", "rule", "closing", "contact", "device", "notice", "elided"):
                own = False
            elif self.bare[i]:
                own = cover < 0.3 and bool(long_lines) if self.known else self.answer[i] and cover < 0.3 and bool(long_lines) and not self.greeting[i] and not _PS.match(x.text)
            elif self.signature[i]:
                own = not all(self._is_name(y) or (len(y.text.split()) <= 6 and not _END.search(y.text)) for y in block) or bool(_PS.match(x.text))
            else:
                own = cover < 0.8
            out[i] = own
        return out


def own_lines(mail: Mail, own: np.ndarray) -> list[int]:
    """The numbers of the non-blank lines of the blocks found to be the sender's own.

    Exact check of what a short line can't tell by itself: a greeting goes with the text that follows it.
    """
    own = list(own)
    for i in range(len(own) - 2, -1, -1):
        b = mail.blocks
        if mail.greeting[i] and len(b[i]) == 1 and not b[i][0].depth and b[i + 1][0].depth == 0 and b[i + 1][0].kind == "text" and b[i][0].kind == "text":
            own[i] = own[i + 1]
    return [y.no for b, o in zip(mail.blocks, own, strict=True) if o for y in b]


def bodies(df: DataFrame, row_id: str = "_row_id", raw: str = "_raw_record") -> DataFrame:
    """(row_id, message_id, body): the plain body, else the text of the HTML one; rows without either are left out."""
    p = df.select(F.col(row_id).alias("_row_id"), payload(F.col(raw)).alias("_p"))
    plain, html = get_text(F.col("_p"), "$.body_plain"), get_text(F.col("_p"), "$.body_text_from_html")
    return p.select("_row_id", F.nullif(get_text(F.col("_p"), "$.message_id_header"), F.lit("")).alias("message_id"), F.coalesce(plain, html).alias("body")).where("body is not null")


def _header(headers: Column, name: str) -> Column:
    hit = F.filter(headers, lambda h: F.lower(F.try_variant_get(h, "$.name", "string")) == name)
    return F.try_variant_get(F.get(hit, F.lit(0)), "$.value", "string")


def message_links(messages: DataFrame) -> DataFrame:
    """(message_id, sender, parent_id, ancestor_ids): one row for each Message-ID, whatever its deliveries. The parent is
    the mail it answers (In-Reply-To, else the last of References), the ancestors are all mails that either names in any
    delivery; never itself."""
    h = messages.select(F.try_variant_get(payload(F.col("_raw_record")), "$.headers", "array<variant>").alias("_h")).where("_h is not null")
    ids = h.select(_header(F.col("_h"), "message-id").alias("message_id"), _header(F.col("_h"), "from").alias("sender"), _header(F.col("_h"), "in-reply-to").alias("_r"), _header(F.col("_h"), "references").alias("_f"))
    parent = F.coalesce(F.nullif(F.regexp_extract("_r", r"<[^<>\s]+>", 0), F.lit("")), F.nullif(F.regexp_extract("_f", r"(<[^<>\s]+>)\s*$", 1), F.lit("")))
    named = F.regexp_extract_all(F.concat_ws(" ", "_r", "_f"), F.lit(r"(<[^<>\s]+>)"))
    ids = ids.select(F.trim("message_id").alias("message_id"), "sender", F.nullif(parent, F.trim("message_id")).alias("parent_id"), F.array_remove(F.array_distinct(named), F.trim("message_id")).alias("_ids")).where("message_id <> ''")
    own = ids.groupBy("message_id").agg(F.max(F.struct(F.col("parent_id").isNotNull(), "parent_id", "sender")).alias("m"), F.array_distinct(F.flatten(F.collect_set("_ids"))).alias("ancestor_ids"))
    return own.select("message_id", "m.sender", "m.parent_id", "ancestor_ids")


def readings(mails: DataFrame) -> DataFrame:
    """(_mid, _s, kinds, covers, known, compared, said, low): the ``Reading`` of each mail beside the mails it answers and
    refers to, its sender's hash, and ``said_lines`` as arrays of hashes and flags. ``mails``: with ``ancestor`` and ``others``, if known."""
    given = [F.col(c) if c in mails.columns else F.lit(None).cast(t).alias(c) for c, t in (("ancestor", "string"), ("others", "array<string>"))]
    names = ["_mid", "_s", "kinds", "covers", "known", "compared", "said", "low"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int8())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE_MAILS):
                mid, s, *texts = (c.to_pylist() for c in whole.slice(start, SLICE_MAILS).columns)
                out = []
                for body, ancestor, others in zip(*texts, strict=True):
                    lines = _lines(body)
                    r = Reading.of(lines, ancestor, others or [])
                    cells = said_lines(lines, r.compared)
                    out.append((r.kinds, r.covers, r.known, r.compared, list(cells), list(cells.values())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((mid, s, *zip(*out, strict=True)), types, strict=True)], names)

    rows = mails.select("_mid", F.xxhash64(F.coalesce("sender", F.lit(""))).alias("_s"), "body", *given)
    return rows.mapInArrow(run, "_mid bigint, _s bigint, kinds binary, covers binary, known boolean, compared boolean, said array<bigint>, low array<tinyint>")


def line_cells(mails: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """(_mid, _s, _l, _t): the lines that each mail's sender says anywhere in it as hashes, with the sender's; _t is 1 for a line
    that only stands below a closing phrase or a rule. ``read``: the mails' ``readings``, best written, as the cells are read twice."""
    read = readings(mails) if read is None else read
    return read.select("_mid", "_s", F.explode(F.arrays_zip("said", "low")).alias("_c")).select("_mid", "_s", F.col("_c.said").alias("_l"), F.col("_c.low").cast("int").alias("_t"))


def frequencies(mails: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """(_mid, lines map<line hash, struct<own share, corpus count, footer share>>): of the lines that each mail's sender
    says, those in more than two mails, with the share of the sender's mails that hold them, the logarithm of the mails that do, and the
    share of these in which they only stand below a closing phrase or a rule.

    Counted over all mails and lines of any length, as hashes; copies within a mail count once; counts are combined
    map-side before they are shuffled, and lines or senders with many rows are joined in parts. ``at``: the mails' ``line_cells``, of written readings at best, as they are read twice.
    """
    at = line_cells(mails) if at is None else at
    count = at.groupBy("_s", "_l").agg(F.count("*").alias("_n"), F.sum("_t").alias("_low"))
    per_line = count.groupBy("_l").agg(F.sum("_n").alias("_all"), F.sum("_low").alias("_below"), F.count("*").alias("_senders")).where(f"_all >= {FOOTER_MAILS}")
    senders = mails.groupBy(F.xxhash64(F.coalesce("sender", F.lit(""))).alias("_s")).agg(F.count("*").alias("_mails"))
    named = join_label(count, per_line, "_l", "_senders", "_s").where("_all is not null").join(senders, "_s")
    named = named.select(F.xxhash64("_s", "_l").alias("_k"), F.struct((F.col("_n") / F.col("_mails")).alias("f"), F.log1p("_all").alias("c"), (F.col("_below") / F.col("_all")).alias("t")).alias("_f"), "_n")
    hits = join_label(at.select("_mid", "_l", F.xxhash64("_s", "_l").alias("_k")), named, "_k", "_n", "_mid").where("_f is not null")
    return hits.groupBy("_mid").agg(F.map_from_entries(F.collect_list(F.struct("_l", "_f"))).alias("lines"))


def ancestors(mails: DataFrame) -> DataFrame:
    """(_mid, ancestor, others): of each mail that refers to mails with a body, the body of the one it answers, if known,
    and those of all others.

    A mail may be a list's to which a third of all mails refer; its body is joined in parts.
    """
    pairs = mails.select("_mid", "parent_id", F.explode("ancestor_ids").alias("_id")).select("_mid", "_id", F.col("_id").eqNullSafe(F.col("parent_id")).alias("_direct"))
    old = mails.where("message_id is not null").groupBy("message_id").agg(F.max_by("body", F.struct("_row_id", "body")).alias("_body"))
    wanted = pairs.groupBy("_id").agg(F.count("*").alias("_n"))
    old = old.join(wanted, old.message_id == wanted._id).select("_id", "_body", "_n")
    found = join_label(pairs, old, "_id", "_n", "_mid").where("_body is not null")
    other = F.array_sort(F.collect_list(F.when(~F.col("_direct"), F.col("_body"))))
    return found.groupBy("_mid").agg(F.max(F.when(F.col("_direct"), F.col("_body"))).alias("ancestor"), other.alias("others"))


def prepared(body_table: DataFrame, messages: DataFrame) -> Table:
    """(_row_id, body, sender, kinds, covers, known, compared, keys, f, c, t): each mail with its reading beside the mails it
    answers and refers to and its lines' frequency."""
    # Row ids may repeat; the written number tells the rows apart.
    numbered = bodies(body_table).withColumn("_mid", F.monotonically_increasing_id())
    first = cut(numbered.join(message_links(messages), "message_id", "left"))
    mails = first.df
    read = cut(readings(mails.join(ancestors(mails), "_mid", "left")))
    kept = read.df.drop("_s", "said", "low")
    full = mails.join(kept, "_mid").join(frequencies(mails, line_cells(mails, read.df)), "_mid", "left")
    # Plain arrays are cheaper to hand to Python than a map of structs.
    said = [F.map_keys("lines").alias("keys"), *[F.map_values("lines")[n].alias(n) for n in ("f", "c", "t")]]
    out = cut(full.select("_row_id", "body", "sender", "kinds", "covers", "known", "compared", *said))
    first.drop()
    read.drop()
    return out


_COLUMNS = ("_row_id", "body", "sender", "kinds", "covers", "known", "compared", "keys", "f", "c", "t")


def _mails(batch: pa.RecordBatch | pa.Table) -> list[Mail]:
    columns = [batch.column(c).to_pylist() for c in _COLUMNS[1:]]
    return [
        Mail(body, None, sender.split("<")[0] if sender else None, dict(zip(keys, zip(f, c, t, strict=True), strict=True)) if keys else None, reading=Reading(*reading))
        for body, sender, *reading, keys, f, c, t in zip(*columns, strict=True)
    ]


def train(mails: DataFrame, bound: int = TRAIN_MAILS) -> Trees:
    """Trees fitted on the labelled blocks of at most ``bound`` mails, those of the least hashes of their row ids."""
    sample = mails.orderBy(F.xxhash64("_row_id"), "_row_id").limit(bound).toArrow()
    made = [m for m in _mails(sample) if m.blocks]
    x = np.concatenate([m.features() for m in made]) if made else np.zeros((0, len(FEATURES)))
    y = np.concatenate([m.label() for m in made]) if made else np.zeros(0)
    return fit(x, y, depth=6, bins=64)


def classify(mails: DataFrame, model: Trees) -> DataFrame:
    """(_row_id, line_no): the sender's own lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # A few mails at a time: their lines take many times the memory of their text.
            for start in range(0, whole.num_rows, SLICE_MAILS):
                b = whole.slice(start, SLICE_MAILS)
                made = _mails(b)
                sizes = [len(m.blocks) for m in made]
                own = model.score(np.concatenate([m.features() for m in made])) > 0 if sum(sizes) else np.zeros(0, bool)
                ids, nos, at = [], [], 0
                for i, m, n in zip(b.column(0).to_pylist(), made, sizes, strict=True):
                    found = own_lines(m, own[at : at + n])
                    at += n
                    ids += [i] * len(found)
                    nos += found
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int64())], ["_row_id", "line_no"])

    return mails.mapInArrow(run, "_row_id bigint, line_no bigint")


def own_text_lines(body_table: DataFrame, messages: DataFrame) -> DataFrame:
    """(_row_id, line_no): each non-blank line newly written by its mail's sender.

    Lines are those of the plain body (of the HTML one's text where that is null), numbered from 1 and split at line
    feeds. Unreadable payloads and mails without a body yield none. Mails pulled twice are mails of their own. A mail
    without a known message has no ancestor and a null sender.
    """
    mails = prepared(body_table, messages).df
    return classify(mails, train(mails))
