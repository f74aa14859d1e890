"""Template residue and error-page text: records that hold machine leftovers instead of content.

A text is a leftover for a placeholder detector's finding, or because it is a response that belongs to no page: its title
(in place of an address slug) promises terms that the body lacks, it has little information, and either its sentences are
known forms of errors, script notices and filler, or the hosts tell: several of them give the same sentence or the same
whole response under titles that promise something else, or in company of such forms. A known form alone decides nothing:
where the title fits the body, only its duplication over hosts whose titles do not fit makes it a leftover. Unlisted
sentences that keep company with known forms at several hosts count as page furniture or as forms themselves, so the
lists need only hold the general ones.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom.operators.skew import join_label
from idloom.storage import cut

#: Organizations that must give the same masked response where it has a telling word or no content sentence.
HOSTS = 3
#: The same for one or two content sentences without a telling word: short prose recurs by chance.
WIDE_HOSTS = 5
#: Share of a sentence's rows that hold a known form from which it is one of its kind.
COMPANY_SHARE = 0.5
#: Rounds in which company is found: forms, sentences in their company, and those in the company of these.
ROUNDS = 3
#: Share of a response's or sentence's rows whose titles may fit it; above, it is what those pages hold.
FITTING_SHARE = 0.1
#: Content sentences up to which a text is of low information.
FEW = 2
#: Words beside a failed value up to which its sentence is a template's wherever the value stands; beyond, its place tells.
CARRIER_WORDS = 9
#: Share of a text's words in filler sentences from which it consists of filler.
FILLER_SHARE = 0.6


_MARKS = regex.compile(r"[\p{Mn}\p{Cf}]+")


def fold(text: str) -> str:
    """Lower case without accents, format characters and repeated blanks."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return " ".join(text.split()).lower()


# What servers, browsers, page builders and mail tools leave behind, in the languages of the corpus.
_SLOT = (
    r"insert|your|first|last|full|name|company|date|amount|title|city|owner|client|customer|recipient|contact|address|e-?mail|phone|plan|link|price|product|"
    r"ihre?|vorname|nachname|firma|datum|betrag|ort|kunde|einfügen|einsetzen|prénom|nom|société|entreprise|montant|ville|votre|compléter|insérer|"
    r"nombre|apellido|empresa|fecha|importe|ciudad|su|insertar|completar"
)
_PLACEHOLDER = re.compile(
    r"\{\{\{?.{1,60}?\}\}\}?|[$#]\{[^{}\n]{1,40}\}|\{%.{1,40}?%\}|<%=?.{1,40}?%>|%[A-Za-z_][A-Za-z_.]{1,30}%|##\w{2,30}##|@@\w{2,30}@@|\*\|[\w.]{2,30}\|\*|\b__[A-Z][A-Z_]*__\b|\[\[[^\[\]\n]{1,40}\]\]|<<[^<>\n]{1,40}>>"
    r"|\{(?:[A-Za-z_]\w*(?:\.\w+)*|\d{1,2})\}|\bXX/XX/XX(?:XX)?\b|\[object Object\]|(?<![A-Za-z0-9%])%[sd](?![A-Za-z0-9])|%\(\w{1,30}\)[sd]"
    rf"|(?i:\[(?:[^\[\]\n]{{0,20}}\b)?(?:{_SLOT})\b[^\[\]\n]{{0,30}}\])|(?i:<(?:{_SLOT})\b[^<>@/\n]{{0,30}}>)|\[[^\[\]\n]{{0,12}}(?:名|会社|日付|金額|挿入|記入)[^\[\]\n]{{0,12}}\]|<[^<>\n]{{0,12}}(?:名|会社|日付|金額|挿入|記入)[^<>\n]{{0,12}}>"
)
_SIGNS = re.compile(r"[{}\[\]<>%#@*_X]").search
_FAILED = re.compile(r"(?<![A-Za-z0-9_\"'.:=/-])(?:undefined|null|NaN|None|N/A)(?![A-Za-z0-9_\"'=/-])")
_ASSIGNED = re.compile(r"^[\s\-*]*[\w.\"' ]{1,40}[:=]\s*\S+$|[{}();]")
_MENTION = re.compile(r"\b(?:merge field|placeholder|compiler|syntax|variable|left in it|template|snippet|we write|escape|is filled|replace[ds]?|platzhalter|gabarit|plantilla)\b", re.I)
_GREETING = r"(?:hi|hello|hey|dear|good (?:morning|afternoon|evening)|hallo|guten (?:tag|morgen|abend)|liebe[rs]?|sehr geehrte[rs]?|moin|bonjour|bonsoir|salut|ch[eè]re?|hola|buen[oa]s (?:d[ií]as|tardes|noches)|estimad[oa]s?|querid[oa])"
# Where only a value can stand: a greeting's name, before a bullet or capital at the start of a text, or after a word that takes one.
_GREETED_SLOT = re.compile(rf"^(?i:{_GREETING}) (?:{_PLACEHOLDER.pattern}) ?(?:[,:!–-]|$)")
_GREETED_FAILED = re.compile(rf"^(?i:{_GREETING}) (?:{_FAILED.pattern}) ?(?:[,:!–-]|$)")
_OPENING = re.compile(rf"^(?:{_FAILED.pattern})(?:$|\s+(?=[^\W\d_a-zß-ÿ]|[-*•–·[]|\d{{1,2}}[.)]))")
_SIGNED = re.compile(r"^[^\W\d_]+(?: [^\W\d_]+){0,3},$")
_TAKES = re.compile(rf"(?i:\b(?:is|was|of|for|to|by|from|with|at|on|until|ist|war|für|von|bis|est|de|pour|par|es|para|hasta)) (?:{_FAILED.pattern})(?=[,.!?;]|$)")
_DATA = re.compile(r"\b(?:fields?|values?|columns?|rows?|keys?|variables?|parameters?|propert(?:y|ies)|defaults?|returns?|returned|records?|quer(?:y|ies)|function|code|json|sql|logs?|bugs?|set to|feld(?:er)?|werte?|spalten?|champs?|valeurs?|colonnes?|campos?|valor(?:es)?|columnas?)\b", re.I)
_ERROR = [
    r"(?:(?:http )?error|fehler|erreur|error del servidor|status)? ?:? ?(?:4\d\d|5\d\d)(?: ?[:\-] ?| )?(?:(?:not found|forbidden|unauthorized|bad gateway|bad request|gateway time-?out|(?:service )?(?:temporarily )?unavailable|service temporarily unavailable|internal server error|too many requests|acc[eè]s refuse|interner serverfehler|del servidor|we could not find that page|page not found|erreur interne|seite nicht gefunden|pagina no encontrada).{0,30})?",
    r"(?:error|fehler|erreur) (?:4\d\d|5\d\d)\b.{0,60}", r"access (?:is )?denied", r"(?:page|file|document) not found", r"not found", r"forbidden", r"bad gateway", r"internal server error", r"gateway time-?out", r"too many requests", r"request blocked",
    r"service (?:is )?(?:temporarily )?unavailable", r"something went wrong.{0,30}", r"oops!?", r"your session has (?:ended|expired)", r"the site can'?t be reached", r"this (?:page|site) isn'?t working.{0,20}",
    r"connection (?:refused|timed out|reset)", r"zugriff verweigert", r"seite nicht gefunden", r"interner serverfehler", r"der dienst ist vorubergehend nicht erreichbar",
    r"ihre sitzung ist abgelaufen", r"etwas ist schiefgelaufen", r"acces refuse", r"page introuvable", r"erreur interne.{0,20}", r"le service est momentanement indisponible", r"votre session a expire", r"une erreur est survenue",
    r"acceso denegado", r"pagina no encontrada", r"el servicio no esta disponible.{0,20}", r"su sesion ha (?:caducado|expirado|terminado)", r"ha ocurrido un error", r"サーバーエラーか?゙?が?発生しました", r"アクセスか?゙?が?拒否されました", r"ペ?ーシ゛?゙?か?゙?見つかりません(?:て゛?゙?した)?",
]
_SCRIPT = [
    r"this (?:site|page|app) (?:works|runs|needs|requires).{0,20}(?:javascript|scripts?).{0,20}", r"java ?script is required.{0,40}", r"sorry, this .{0,20}needs java ?script", r"loading.{0,6}\(?scripts? must be allowed\)?", r"please (?:enable|turn on|activate|allow) (?:java ?script|scripts?|cookies).{0,50}",
    r"you need to (?:enable|turn on|allow) (?:java ?script|scripts?).{0,60}", r"your browser (?:has|does not).{0,20}(?:script|java ?script).{0,30}", r"noscript\b.{0,40}", r".{0,60}you (?:are|re) (?:not a robot|human).{0,30}", r"(?:enable|turn on|allow) (?:both|them)(?: and .{1,24})?", r"checking your browser before.{0,30}", 
    r"cette (?:application|page|site).{0,20}(?:besoin|necessite).{0,30}(?:scripts?|javascript).{0,20}", r"activez (?:javascript|les scripts).{0,50}", r"veuillez activer.{0,60}", r"votre navigateur.{0,30}scripts?.{0,20}", r"esta (?:aplicacion|pagina).{0,20}necesita.{0,10}(?:scripts|javascript).{0,20}",
    r"(?:por favor )?active (?:javascript|los scripts).{0,50}", r"su navegador.{0,30}scripts?.{0,20}", r"bitte aktivieren sie (?:javascript|skripte).{0,50}", r"(?:ihr )?browser .{0,24}skripte?.{0,20}", r".{0,30}skripte? (?:benotigt|erforderlich|notig)", r".{0,12}(?:javascript|スクリプト)か?゙?が?必要て?゙?で?す", r".{0,24}javascriptを有効にしてください",
]
_FILLER = [
    r"this is (?:dummy|sample|placeholder|filler) text", r"your (?:content|text) (?:goes )?here", r"text to follow", r"headline goes here", r"tbd", r"(?:blah ?)+", r"(?:test ?)+", r"(?:asdf ?)+",
    r"(?:enter|add|insert) (?:your )?text here", r"body copy.{0,16}", r"write something about .{1,30}", r"(?:add|enter|insert|write) (?:a|your) (?:short |brief )?description.{0,24}", r"texte a venir", r"ceci est un faux texte", r"texto de ejemplo", r"aqui va el contenido",
    r"text folgt", r"hier steht blindtext", r"ここに本文が入ります", r"ダミーテキストです", r"(?:foo|bar|baz|qux|asdf|qwer|qwerty|jkl|zzz|xxx|abc)(?: (?:foo|bar|baz|qux|asdf|qwer|qwerty|jkl|zzz|xxx|abc))*",
]
_FURNITURE = [
    r"[©].{0,60}", r"\(c\) .{0,50}", r"menu", r"(?:log|sign) ?(?:in|up)(?: .{1,16})?", r"(?:go |return |get )?back to (?:the |our )?(?:home|start|main).{0,12}", r"if (?:this|the (?:problem|error|issue)) (?:keeps|persists|continues|happens).{0,50}", r"(?:please )?check the (?:address|url|link|spelling).{0,40}", r"the server (?:said|responded|returned|replied).{0,20}", r"skip to content", r"cookie (?:choices|settings|policy)", r"(?:\S+ ){1,3}status", r"[^|.]{1,30}(?: \| [^|.]{1,30})+", r"request id:? ?\w+", r"(?:ref|vorgang|reference)\.?:? ?\w{4,}", r"ref\.?", r"\w{6,}",
    r"nginx.{0,10}", r"apache.{0,20}", r"at \w+ \(.{0,40}\)", 
    r"(?:please )?try again (?:later|in a few minutes)", r"veuillez reessayer plus tard", r"bitte versuchen sie es spater erneut", r"intentelo de nuevo mas tarde", r"しばらくしてからもう一度お試しください", r"[\W\d_]*",
]
_LATIN = frozenset(
    "ad adipiscing aliqua aliquip amet anim aute cillum commodo consectetur consequat culpa cupidatat deserunt do dolor dolore duis ea eiusmod elit enim esse est et eu ex excepteur exercitation fugiat id in incididunt ipsum irure labore laboris laborum lorem magna minim mollit nisi non nostrud nulla occaecat officia pariatur proident qui quis reprehenderit sed sint sit sunt tempor ullamco ut velit veniam voluptate".split()
)


_WORDS = re.compile(r"[^\W\d_]+").findall


def _union(patterns: list[str], repeat: str = "") -> re.Pattern:
    # The texts are compared without combining marks, so the patterns are stripped of them too.
    plain = "|".join("".join(c for c in unicodedata.normalize("NFKD", p) if unicodedata.category(c) != "Mn") for p in patterns)
    return re.compile(f"(?:(?:{plain}){repeat})+" if repeat else plain)


_ERRORS, _SCRIPTS, _PAGES = map(_union, (_ERROR, _SCRIPT, _FURNITURE))
_FILLERS = _union(_FILLER, r"(?:[ .!]+|\Z)")
_WEAK = _union([
    r"\b(?:error|fehler|erreur|4\d\d|5\d\d|denied|unavailable|forbidden|javascript|scripts?|cookies|captcha|browser|expired|timed? ?out|maintenance|wartung)\b", r"\b(?:denegado|no disponible|caducad[oa]|expirad[oa]|navegador|mantenimiento|tiempo de espera)\b", r"エラー|拒否されました|利用できません|ご利用いただけません|有効期限|ブラウザ|メンテナンス|タイムアウト",
])
# What differs between copies of one response: identifiers, dates and times; other numbers tell prose apart.
_AGAIN = re.compile(r"(\S+(?: \S+){1,11}?)[.!]?(?: \1[.!]?){2,}(?: .{0,60})?")
_TICKET = re.compile(r"\b(?=\w*\d)(?=\w*[a-z])\w{6,}\b|\b[0-9a-f]{6,}\b|\d{1,4}[-./]\d{1,2}[-./]\d{1,4}|\d{1,2}:\d\d(?::\d\d)?|\d{6,}")
_TAG = re.compile(r"</?(?:html|head|body|title|p|br|h[1-6]|div|span|center|hr|pre|noscript|script|style)\b[^<>]{0,80}>", re.I)
_JSON = re.compile(r'^\s*\{\s*"error"\s*:.*"message"\s*:\s*"((?:[^"\\]|\\.)*)"', re.S)
_CUT = re.compile(r"\n|(?<=[.!?。])\s+(?=\S)|(?<=。)")
_BULLET = re.compile(r"^(?:[-*•–·]|\d{1,2}[.)]|\[\d\d:\d\d\] \w+:)\s+")
_CJK = re.compile(r"[぀-ヿ一-鿿가-힯]")


def sentences(text: str) -> list[str]:
    """The sentences of a text by lines and full stops; tags count as line ends, an error object as its message."""
    m = _JSON.match(text)
    if m:
        text = m.group(1)
    text = _TAG.sub("\n", text)
    return [s for x in _CUT.split(text) if (s := _BULLET.sub("", x.strip()).strip())]


def has_placeholder(sentence: str, first: bool = False) -> bool:
    """Whether a sentence holds an unfilled placeholder, or a failed value in a placeholder's place, and is not about one.

    A greeted one is a leftover whatever follows, as a text without line ends is one long sentence; ``first``: the
    sentence opens its text or follows a closing.
    """
    s = html.unescape(sentence) if "&lt;" in sentence else sentence
    if not _SIGNS(s) and not _FAILED.search(s):
        return False
    if _GREETED_SLOT.match(s) or _GREETED_FAILED.match(s):
        return True
    if _PLACEHOLDER.search(s) and not _MENTION.search(_PLACEHOLDER.sub(" ", s)):
        return True
    if _PLACEHOLDER.search(s) or not _FAILED.search(s):
        return False
    rest = _FAILED.sub(" ", s)
    if _MENTION.search(rest):
        return False
    if first and _OPENING.match(s):
        return True
    if _ASSIGNED.search(s):
        return False
    n = len(re.findall(r"\w+", rest))
    return 1 <= n and (n <= CARRIER_WORDS or bool(_TAKES.search(s)) and not _DATA.search(rest))


def _latin(words: list[str]) -> bool:
    return len(words) >= 4 and sum(map(_LATIN.__contains__, words)) >= 0.7 * len(words)


def _print(kind: str, parts: list[str]) -> str:
    return hashlib.md5("\n".join([kind, *parts]).encode("utf-8", "replace")).hexdigest()


class Reading(NamedTuple):
    """What one text says by itself."""

    placeholder: bool
    #: Nothing but known forms and page furniture, or mostly filler.
    bare: bool
    #: Holds a sentence of a known form.
    known: bool
    #: 2 for a telling word, 1 for no content sentence, else 0.
    evidence: int
    #: Fingerprint of the whole masked response, where it has little information and no known form.
    response: str | None
    #: The title's terms are in the body.
    fits: bool
    #: Fingerprints of the sentences that hosts are asked about: those of known form, the others, and those of a word or two.
    forms: list[str]
    others: list[str]
    shorts: list[str]


def read(text: str, title: str | None) -> Reading:
    """Reads one text. Texts of more than FEW content sentences and without a known form are no candidates: they have
    neither a response nor sentences."""
    parts = sentences(text)
    placeholder = any(has_placeholder(p, i == 0 or bool(_SIGNED.match(parts[i - 1]))) for i, p in enumerate(parts))
    content = known = filler_words = all_words = unspaced = 0
    masked, every, forms, others, shorts = [], [], [], [], []
    for p in parts:
        f = fold(p).strip(" .!…。*_=-#>\"'")
        w = _WORDS(f)
        cjk = not f.isascii() and bool(_CJK.search(f))
        size = len(f) // 3 if cjk else len(w)
        every.append(f)
        if _latin(w):
            filler_words += max(size, 1)
            all_words += max(size, 1)
            known += 1
        elif _FILLERS.fullmatch(f) or (len(w) > 5 and w.count(w[0]) > 2 and _AGAIN.fullmatch(f)):
            filler_words += max(size, 1)
            all_words += max(size, 1)
            known += 1
            forms.append(f)
        elif _ERRORS.fullmatch(f) or _SCRIPTS.fullmatch(f):
            known += 1
            all_words += size
            forms.append(f)
        elif _PAGES.fullmatch(f) or size <= 2:
            # A sentence without blanks looks like an identifier.
            if not (cjk and size > 2):
                if f and not _PAGES.fullmatch(f):
                    shorts.append(f)
                continue
            unspaced += 1
            others.append(f)
        else:
            content += 1
            all_words += size
            others.append(f)
        masked.append(f)
    times = sorted(map(others.count, set(others)))
    if len(others) > 2 and (times[0] > 1 and len(others) > 1.5 * len(times) or times[-1] > 2 and times[-1] >= 0.6 * len(others)):
        # Little but sentences that are said again and again.
        forms, known, filler_words, content, unspaced, others = forms + others, known + len(others), all_words, 0, 0, []
    bare = (known > 0 and content == 0) or (all_words > 0 and filler_words >= FILLER_SHARE * all_words)
    if not known and (not any(every) or content + unspaced > FEW):
        return Reading(placeholder, bare, False, 0, None, False, [], [], [])
    # Terms that the title (the address slug, where there is one) promises and the body lacks.
    promised = set(re.findall(r"[^\W\d_]{3,}", fold(title or "")))
    given = set(re.findall(r"[^\W\d_]{3,}", fold(text))) if promised else set()
    fits = bool(promised) and len(promised & given) >= 0.3 * len(promised)
    response, evidence = None, 0
    weak = any(_WEAK.search(f) for f in others if len(f) < 90 or len(_WORDS(f)) <= 2)
    if not known and len(re.findall(r"[^\W\d_]+", " ".join(every))) > 1:
        # One word alone may be what a cut left of any text.
        if weak:
            response, evidence = _print("weak", [re.sub(r"\d+", "9", re.sub(r"\b[0-9a-f]{6,}\b", "h", f)) for f in masked]), 2
        else:
            response, evidence = _print("plain", [_TICKET.sub("h", f) for f in masked or every]), int(content + unspaced == 0)
    asked = lambda fs: [_print("sentence", [_TICKET.sub("h", f)]) for f in sorted(set(fs))]
    return Reading(placeholder, bare, known > 0, evidence, response, fits, asked(forms), asked(others), asked(shorts))


_READING = "placeholder boolean, bare boolean, known boolean, evidence int, response string, fits boolean, forms array<string>, others array<string>, shorts array<string>"
_READING_TYPES = [pa.bool_(), pa.bool_(), pa.bool_(), pa.int32(), pa.string(), pa.bool_(), *[pa.list_(pa.string())] * 3]


def judge(df: DataFrame, doc_id: str, text: str, title: str, host: str) -> DataFrame:
    """(_id, host, and the fields of a Reading): what each text says by itself. Null and blank texts give no row."""
    id_type = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [read(t, n) for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            cols = [pa.array([g[k] for g in got], t) for k, t in enumerate(_READING_TYPES)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), *cols], ["_id", "host", *Reading._fields])

    # trim() may keep other blanks; such a text has no sentences and is not flagged.
    rows = df.where(F.col(text).isNotNull() & (F.trim(F.col(text)) != "")).select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(title).alias("_title"), F.col(host).cast("string").alias("host"))
    return rows.mapInArrow(run, f"_id {id_type}, host string, {_READING}")


def hosted(rows: DataFrame, key: str, *more: Column) -> DataFrame:
    """(key, _n rows, _hosts, _fit, more): over how many hosts with titles of other terms each fingerprint is spread, and
    how many of its rows have a fitting title. Counted map-side."""
    return rows.groupBy(key).agg(F.count_distinct(F.when(~F.col("fits"), F.coalesce("host", F.lit("")))).alias("_hosts"), F.count("*").alias("_n"), F.count_if("fits").alias("_fit"), *more)


def evidence(df: DataFrame, doc_id: str, text: str, title: str, host: str, hosts: int = HOSTS, wide_hosts: int = WIDE_HOSTS, rounds: int = ROUNDS) -> DataFrame:
    """(_row, _id, reason): the rows that hold residue and what decides it.

    ``placeholder``: the detectors. ``mismatch``: known forms alone, under a title that promises other terms or none.
    ``mismatch and hosts``: the same, and a sentence of it is spread over hosts. ``hosts``: known forms under a fitting title or
    among unlisted sentences, or no known form at all, where duplication over hosts decides.
    """
    # Row ids may repeat; the written number tells the rows apart.
    j = cut(judge(df, doc_id, text, title, host).withColumn("_row", F.monotonically_increasing_id())).df
    alone = (F.size("others") == 1) & (F.size("forms") == 0)
    asked = j.where("not placeholder and size(forms) + size(others) + size(shorts) > 0")
    one = lambda c: asked.select("_row", "host", "fits", "known", F.explode(c).alias("print"), F.lit(c).alias("kind"), (alone & F.lit(c == "others")).alias("alone"))
    said = cut(one("forms").unionByName(one("others")).unionByName(one("shorts")))
    spread = (F.col("_hosts") >= hosts) & (F.col("_fit") <= FITTING_SHARE * F.col("_n"))
    whole_hosts = F.count_distinct(F.when(F.col("alone") & ~F.col("fits"), F.coalesce("host", F.lit(""))))
    for i in range(rounds):
        about = hosted(said.df, "print", F.count_if("known").alias("_known"), whole_hosts.alias("_alone"))
        company = spread & ((F.col("_known") >= COMPANY_SHARE * F.col("_n")) | (F.col("_alone") >= wide_hosts))
        about = about.select("print", "_n", spread.alias("_spread"), company.alias("_company"))
        told = join_label(said.df, about, "print", "_n", "_row").withColumn("_kin", F.col("_company") & (F.col("kind") != "forms"))
        heard = told.groupBy("_row").agg(F.bool_or("_spread").alias("_spread"), F.bool_or("_kin").alias("_company"), F.bool_and((F.col("kind") != "others") | F.col("_company")).alias("_closed"))
        if i + 1 < rounds:
            known = told.groupBy("_row").agg(F.bool_or(F.col("_kin")).alias("_more"))
            # A row has few sentences, so these groups are small.
            nxt = cut(said.df.join(known, "_row").withColumn("known", F.col("known") | F.col("_more")).drop("_more"))
            said.drop()
            said = nxt
    whole = hosted(j.where("response is not null"), "response", F.max("evidence").alias("_evidence"))
    enough = (F.col("_hosts") >= F.when(F.col("_evidence") > 0, hosts).otherwise(wide_hosts)) & ((F.col("_evidence") == 2) | (F.col("_fit") <= FITTING_SHARE * F.col("_n")))
    whole = whole.where(enough).select("response", "_n").withColumn("_dup", F.lit(True))
    again = join_label(j.where("response is not null and not fits and not placeholder").select("_row", "response"), whole, "response", "_n", "_row").where("_dup").select("_row", F.lit(True).alias("_dup"))
    told = j.select("_row", "_id", "placeholder", "bare", "known", "fits").join(heard, "_row", "left").join(again, "_row", "left").fillna(False)
    reason = (
        F.when(F.col("placeholder"), "placeholder")
        .when(F.col("bare") & ~F.col("fits") & ~F.col("_spread"), "mismatch")
        .when(F.col("bare") & ~F.col("fits"), "mismatch and hosts")
        .when(F.col("bare") & F.col("_spread") | (F.col("known") | F.col("_company")) & F.col("_closed") & (~F.col("fits") | F.col("_spread")) | F.col("_dup"), "hosts")
    )
    return told.select("_row", "_id", reason.alias("reason")).where("reason is not null")


def residue(df: DataFrame, doc_id: str, text: str, title: str, host: str, hosts: int = HOSTS, wide_hosts: int = WIDE_HOSTS) -> DataFrame:
    """(doc_id): the documents that hold residue instead of content, one row for each of their rows.

    Null, empty and blank texts are none. A null title promises nothing and counts as unlike any body; null hosts count
    as one host. Sentences and responses are compared by fingerprints over all candidates, counted map-side; one that a
    third of all rows share is joined back in parts.
    """
    return evidence(df, doc_id, text, title, host, hosts, wide_hosts).select(F.col("_id").alias(doc_id))


def without_residue(df: DataFrame, doc_id: str, text: str, title: str, host: str) -> DataFrame:
    """``df`` without the documents found by ``residue``; null and blank texts stay."""
    return df.join(residue(df, doc_id, text, title, host).distinct(), doc_id, "left_anti")
