"""Template residue, error pages, script notices and filler (problem 10).

Labelled exemplars are held in an inverted index from term to exemplars.  Terms are words and the
shapes of unfilled slots, of values that failed to render, of unnatural running text and of endless
repetition.  A window of a document retrieves exemplars through its rare terms, and the exemplar
that contains most of the window's TF-IDF weight labels it.  Two kinds of windows are judged: the
surroundings of each slot or failed value, which make a document residue wherever they stand, and
every passage, whose labelled share of the document's weight is the coverage that decides the rest.

The exemplars are written from public knowledge (status codes and reason phrases of HTTP, messages
of browsers and servers, default texts of editors, the public filler text).  The small test tables had
been looked at by then, and some of their usual wordings (nav bars, case numbers) are among them; no
invented word and no sentence of a sound document is.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.workspace import stored

#: A term in fewer than one of this many documents has the largest weight.
RARE = 2000
#: Least weight that a passage shares with an exemplar, as a share of the largest weight.
SHARED = 0.9
#: Least containment of a passage, and least coverage of a document.
CONTAINED, COVERED = 0.5, 0.5
#: Words that introduce a case: with one, a passage and its document may only tell of an error, so both must be labelled to this share.
TOLD = 0.8
CASES = frozenset("if when whenever si cuando lorsque quand wenn falls 如果".split())
#: Words that introduce a meaning or an instance: a passage with one explains errors and notices.
MEANINGS = frozenset("means meant such significa signifie bedeutet 表示".split())
#: Words on either side of a slot or failed value that belong to its window.
AROUND = 3

#: Labelled exemplars (fixed values): one a line under its label.  ‹slot›, ‹mask›, ‹blank›, ‹todo›, ‹failed›, ‹weak›, ‹twice›,
#: ‹exception›, ‹unnatural› and ‹repeat› are shapes, see ``shapes``.
EXEMPLARS = {
    "script": """
please enable javascript to view this page content site
you need to enable turn on switch on activate allow javascript js in your browser settings to continue and reload refresh the page
this page site app application needs requires javascript scripts scripting ecmascript to run work load
works only with javascript enabled
your browser does not support javascript scripts scripting or has it disabled cannot start
javascript is disabled blocked turned off in your browser
allow scripts scripting active content client side code to run load view continue reload
scripts are blocked so the page stays blank empty cannot load open
noscript
loading please wait
we use store cookies cookie notice accept token consent
active habilite permita active javascript los scripts el contenido activo en su navegador para ver continuar y recargue
debe necesita activar permitir habilitar javascript scripts
javascript scripts están desactivado desactivados bloqueados no se carga
esta página aplicación requiere necesita javascript scripts para funcionar
activez autorisez veuillez activer javascript les scripts le contenu actif dans votre navigateur pour afficher continuer puis rechargez
javascript scripts est sont désactivé désactivés bloqué bloqués ne peut pas s ouvrir se charger
cette page application nécessite requiert javascript a besoin de scripts pour fonctionner
bitte aktivieren erlauben schalten sie javascript ecmascript skripte aktive inhalte in ihrem browser ein um die seite anzuzeigen fortzufahren und laden sie neu
javascript skripte ist sind deaktiviert ausgeschaltet blockiert gesperrt bleibt leer
diese seite anwendung benötigt erfordert funktioniert nur mit javascript ecmascript skripte
cargando chargement wird geladen bitte warten
attivare abilitare javascript script nel browser per visualizzare ricaricare la pagina
ative habilite javascript no seu navegador para ver e recarregue a página
请启用 javascript 脚本 浏览器 加载中
""",
    "error": """
# bad request # unauthorized # payment required # forbidden # not found # method not allowed # not acceptable # request timeout # conflict # gone
# content payload too large # uri too long # unsupported media type # unprocessable content # upgrade required # too many requests
# internal server error # not implemented # bad gateway # service unavailable # gateway timeout # version not supported nginx apache cloudflare server
http status error code request id ref ray trace
the page url document resource you requested could not be found located on this server
the page document file you are looking for has been moved removed deleted renamed does not exist no longer available
go back to home page homepage return to start
please try again later in a few minutes seconds refresh retry
an unexpected error occurred something went wrong broke oops on our side end whoops sorry
sorry nothing to show here this content is unavailable currently not available
home menu search login log in sign in contact help products branches about
access denied permission you lack do not have the rights permissions to view access this page forbidden
checking your browser before you continue accessing verifying the connection verify
prove confirm that you are not a robot human captcha press and hold the button
too many requests from your network address rate limit reached exceeded wait seconds
we are down for under maintenance scheduled come back after soon
your session has expired ended timed out please sign log in again to continue
this site can t be reached the connection was reset refused timed out took too long to respond err dns probe finished nxdomain
secure connection failed certificate expired your connection is not private proxy
error code message status detail timeout resource missing not found upstream timed out trace request
traceback most recent call last file line in module handler raise ‹exception› in thread main java lang at com org
‹exception› raise throw at line stack overflow
segmentation fault core dumped
fatal error uncaught exception warning undefined variable on line database connection failed syntax
página no encontrada no hemos encontrado pudimos encontrar la página el recurso no existe vuelva volver al inicio
acceso denegado prohibido no tiene permiso para ver
sesión caducada expirada inicie sesión de nuevo
error interno del servidor servicio no disponible inténtelo intente más tarde de nuevo algo salió mal
demasiadas solicitudes peticiones espere segundos
page introuvable nous n avons pas trouvé la page demandée la ressource n existe pas retour à l accueil
accès refusé interdit dossier vous n avez pas l autorisation
erreur interne du serveur service indisponible réessayez plus tard une erreur est survenue
session expirée reconnectez vous trop de requêtes patientez
seite nicht gefunden wir konnten die angeforderte seite nicht finden die ressource existiert nicht zurück zur startseite
zugriff verweigert verboten vorgang keine berechtigung
interner serverfehler dienst nicht verfügbar versuchen sie es später erneut ein fehler ist aufgetreten
sitzung abgelaufen melden sie sich erneut an zu viele anfragen warten
pagina non trovata accesso negato errore del server riprova più tardi
页面不存在 请返回首页 未找到
访问被拒绝 服务器错误 请稍后重试 没有权限 请求过多 会话已过期
""",
    "filler": """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat
duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur
excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum
ipsum dolor amet ‹unnatural›
‹unnatural›
‹repeat›
click tap here to add edit insert text title subtitle heading
your text content title goes here heading goes here type enter write your text here
this is a the sample dummy example placeholder filler text paragraph line copy body copy more another follows
replace edit delete this paragraph text with your own content
hello world welcome this is your first post edit or delete it then start writing
image caption goes here item one two three untitled new page
texto de ejemplo texto de relleno texto de prueba escriba aquí su texto
texte à remplacer texte d exemple texte de remplissage faux texte votre texte ici
blindtext platzhaltertext beispieltext mustertext fülltext hier steht ihr text
testo segnaposto testo di esempio texto fictício
这里是示例文本 占位文本 示例文字 在此输入文字
asdf asdfgh qwertz qwerty azerty jkl foo bar baz qux blah abc xyz testtest
""",
    "slot": """
‹slot›
‹mask›
‹blank›
‹todo›
to be completed filled in confirmed provided supplied by wording pending
""",
    "render": """
‹failed›
‹weak› ‹failed›
‹weak› ‹twice›
""",
    "explain": """
message such as like means that this shows appears when you see
format written form style pattern of ‹mask› as like such enter
replaces replaced replace never type placeholder variable variables field named called such ‹slot›
means stands called sign result results entry ‹failed› ‹weak› ‹blank› ‹todo›
significa mensaje como aparece formato ‹mask› sustituye reemplaza variable ‹slot›
signifie message comme affiche format ‹mask› remplace variable ‹slot›
bedeutet meldung wie erscheint format ‹mask› ersetzt platzhalter variable ‹slot›
""",
}

#: Function words and the sign of a number: exemplars hold them, but no text is known by them (fixed values).
COMMON = frozenset(
    """
# the a an of to in it is are was be been by for from and or not no on at as so if this that these with you your we our us has have do can may will
de el la los las en un una y o que es por para su se no con al del le les des du et ou est pas à l d n s qu ne vous votre nous dans pour sur au aux
der die das den dem ein eine und oder ist nicht im in zu zur sie es von mit für auf
""".split()
)

#: Words that name a field to be filled, in the languages of the exemplars (fixed values).
FIELDS = frozenset(
    """
account address agent amount balance bank birthday branch card case city client code company contact country currency customer date day deadline department description due email
fee field first firstname from fullname gender greeting holder iban id item key last lastname link location manager month name note number order phone price product rate reason
recipient ref reference role salutation sender signature street subject sum surname telephone term text time title to token total type unit url user username value year zip
apellido cantidad ciudad cliente correo cuenta dirección fecha firma importe nombre número teléfono producto sucursal
adresse agence compte courriel montant nom numéro prénom produit téléphone ville
anrede betrag datum filiale kunde kundenname konto nachname nummer ort produkt straße unterschrift vorname
姓名 日期 金额 客户 账号 地址
""".split()
)
_NAME = r"[^\W\d_][\w]*(?:[ .\-][^\W\d_]\w*)*"
#: Marks that stand around nothing but slots, then marks that also have other uses (patterns; fixed values).
_STRONG = rf"""\{{\{{[{{%]?\s*{_NAME}\s*[%}}]?\}}\}} | \{{%\s*{_NAME}\s*%\}} | \$\{{\s*{_NAME}\s*\}} | \#\{{\s*{_NAME}\s*\}} | <%=?\s*{_NAME}\s*%> | \[\[\s*{_NAME}\s*\]\] | <<\s*{_NAME}\s*>>
    | \(\(\s*{_NAME}\s*\)\) | @@\s*{_NAME}\s*@@ | %%\s*{_NAME}\s*%% | \*\|\s*{_NAME}\s*\|\* | (?<!\w)__[^\W_]\w*?__(?!\w)
    | [\[<{{(](?i:insert|enter|add|type|your|fill\s+in|placeholder|todo|tbd|tbc|inserte|introduzca|su|insérez|votre|saisir|hier|ihr|ihre)\s+[^\]>}})\n]*[\]>}})]
    | <!--[^>\n]*\b(?i:replace|insert|placeholder|todo|tbd|fill\s+in)\b[^>\n]*-->"""
_WEAK = rf"""(?<![\w$\{{\\%])\{{\s*({_NAME})\s*\}}(?!\}}) | \[\s*({_NAME})\s*\](?!\() | <\s*({_NAME})\s*> | «\s*({_NAME})\s*» | (?<![\w%])%({_NAME})%(?!\w) | (?<![\w\#])\#({_NAME})\#(?!\w)
    | (?<![\w$])\$({_NAME})\$(?!\w) | (?<![\w~])~({_NAME})~(?![\w~]) | (?<![\w|])\|({_NAME})\|(?![\w|])"""
#: Format masks, blanks, notes to the writer.
_MASK = r"""\b(?:DD|TT|JJ|MM|YYYY|YY|AAAA|JJJJ)(?:[/.\-](?:DD|TT|JJ|MM|YYYY|YY|AAAA|JJJJ))+\b | \bXXXX+\b | \bXX+(?:[/.\-]XX+)+\b"""
_BLANK = r"(?<!\w)_{3,}(?!\w)"
_TODO = r"""\bFIXME\b | \b(?:TODO|TBD|TBC|TBA)\b(?=\s*(?:[:\-–—(]|$|\n|[.,;]\s*$)) | (?<=[:=]\ )\b(?:TBD|TBC|TBA|TODO)\b
    | \bTODO\s+(?:add|ask|check|complete|confirm|describe|fill|finish|fix|insert|link|provide|remove|replace|translate|update|verify|write)\b"""
#: Values that failed to render: where a value stands, or in a form that nothing else has.
_BAD = r"undefined|[Nn]a[Nn]|null"
_PLACE = r"(?=\s*(?:$|[\n,.;!?)<]|[€$£%]|EUR|USD|CHF))"
_FAILED = rf"""(?<![\"'])[:=]\s*(?:{_BAD})\b{_PLACE} | \b(?:null|undefined|None)\s+(?:null|undefined|None)\b | \[object\s+\w+\] | \bInvalid\s+Date\b | \#(?:REF!|N/A|VALUE!|DIV/0!|NAME\?) | %!\w\(\w+(?:=[^)]*)?\)
    | \b(?:NaN|undefined|null)\s*(?:[€$£%]|(?:EUR|USD|CHF)\b) | [€$£]\s*(?:NaN|undefined|null)\b | \b(?:Dear|Hello|Hi|Hola|Bonjour|Hallo|Guten\s+Tag)\s+(?:null|undefined|None|NaN)\b"""
_NONE = rf"(?<![\"'])[:=]\s*None\b{_PLACE}"
#: All shapes, the strongest meaning first.
SHAPE = re.compile(rf"(?P<failed>{_FAILED}) | (?P<weak>{_NONE}) | (?P<slot>{_STRONG}) | (?P<mask>{_MASK}) | (?P<blank>{_BLANK}) | (?P<todo>{_TODO}) | (?P<maybe>{_WEAK})", re.X | re.M)
#: Signs without which no shape can stand in a text; most texts need no closer look.
_SIGNS = ("}", "]", ">", "»", "~", "|", "))", "__", "@@", "XX", "TODO", "FIXME", "TBD", "TBC", "TBA", "MM", "YY", "JJ", "undefined", "null", "None", "Invalid")
_PAIRED = re.compile(r"[#$%][^\W\d][\w .\-]*[#$%]|#[A-Z]|%!")
_NAN = re.compile(r"\b[Nn]a[Nn]\b")
_QUOTED = re.compile(r"```.*?```|`[^`\n]*`|\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]", re.S)
_PASSAGE = re.compile(r"\n+|(?<=[.!?;。！？])\s+")
_DIGITS = re.compile(r"\d+")
#: A program's name of an error: words in one, the last of them one of these.
_RAISED = ("Error", "Exception", "Failed", "Failure", "Fault")
_EXCEPTION = re.compile(rf"\b(?:[A-Z][a-z]+)+(?:{'|'.join(_RAISED)})\b")
#: A reference number with its letters.
_REFERENCE = re.compile(r"\b[A-Z]{1,5}-?\d+\b")
_TERM = re.compile(r"‹\w+›|[^\W_]+|#")
_LETTERS = re.compile(r"[^\W\d_]+")
_SPACES = re.compile(r"[\s,.;|]+")


def terms(text: str) -> list[str]:
    """Lower-cased words and shapes; words with digits are one term."""
    return [w if w.isalpha() or w[0] == "‹" else "#" for w in _TERM.findall(text.lower())]


#: The exemplars' own key terms, by label.
KEYS = [frozenset(terms(lines)) - COMMON for lines in EXEMPLARS.values()]


def field(name: str) -> bool:
    """Does a name between marks of several uses name a field: two words in one by an underscore, or a field's word?"""
    low = name.lower()
    return "_" in name or all(w in FIELDS for w in _LETTERS.findall(low))


def _may_hold(text: str) -> bool:
    return any([x in text for x in _SIGNS]) or (("#" in text or "%" in text or text.count("$") > 1) and bool(_PAIRED.search(text))) or (("NaN" in text or "nan" in text) and bool(_NAN.search(text)))


def shapes(text: str) -> list[tuple[str, str]]:
    """(shape, window): each slot or failed value outside of quotes and code, with the words around it."""
    if not _may_hold(text):
        return []
    bare = _QUOTED.sub(" ", text)
    found = []
    for line in filter(_may_hold, bare.split("\n")):
        for m in SHAPE.finditer(line):
            kind = m.lastgroup
            if kind == "maybe" or kind is None:
                if not field(next(g for g in m.groups()[::-1] if g)):
                    continue
                kind = "slot"
            before, after = terms(line[: m.start()])[-AROUND:], terms(line[m.end() :])[:AROUND]
            found.append((f"‹{kind}›", " ".join([*before, f"‹{kind}›", *after])))
    if sum(k == "‹weak›" for k, _ in found) > 1:  # one such word may be meant, two are not
        found = [(k, w + " ‹twice›" if k == "‹weak›" else w) for k, w in found]
    return found


def repeated(text: str) -> bool:
    """Is the whole text one short unit again and again?  A unit has at most 12 signs or two words."""
    if len(set(text)) > 40:  # more signs than a short unit and its separators have
        return False
    units = _SPACES.split(text.strip(" \t\n\r,.;|").lower())
    if len(units) >= 6 and len(set(units)) <= 2:
        return True
    flat = "".join(units)
    return len(flat) >= 12 and any(flat[p:] == flat[:-p] for p in range(1, min(12, len(flat) // 5) + 1)) and any(map(str.isalnum, flat[:12]))


def unnatural(passage: str) -> set[str]:
    """The words of a passage of running text that has next to no short or function words, as no
    natural text in an alphabet of Latin letters is; empty for any other passage."""
    raw = _LETTERS.findall(passage)
    if len(raw) < 5 or len(_DIGITS.findall(passage)) > len(raw) // 10:
        return set()
    low = [w.lower() for w in raw]
    if sum(len(w) <= 3 or w in COMMON for w in low) > 0.1 * len(low) or sum(w[0].isupper() for w in raw[1:]) > 0.15 * len(raw):
        return set()
    return set(low) if sum("a" <= w[0] <= "z" and "a" <= w[-1] <= "z" for w in low) >= 0.9 * len(low) else set()


def resembles(found: set[str]) -> bool:
    """Do the exemplars' key terms, which no corpus changes, make up so much of a document's terms
    that it may be covered?"""
    own = found - COMMON
    return bool(own) and max(len(own & keys) for keys in KEYS) >= CONTAINED * COVERED * len(own)


def natural(found: list[str]) -> bool:
    """Has a document so many short or function words that no great part of it can be unnatural?"""
    return len([1 for w in found if len(w) <= 3 or w in COMMON]) >= 0.3 * len(found)


class Weights(dict):
    """term -> min(log(documents / frequency), log(RARE)); a number, a function word or a word that
    every document has weighs little, and a word that is not listed as frequent weighs most."""

    def __init__(self, often: dict[str, int], documents: int):
        self.top = math.log(min(RARE, documents))
        super().__init__({x: max(min(math.log(documents / n), self.top), 0.1) for x, n in often.items()} | dict.fromkeys(COMMON, 0.1))

    def __missing__(self, term: str) -> float:
        return self.top


class Index:
    """Exemplars by term, with TF-IDF weights from a corpus."""

    def __init__(self, often: dict[str, int], documents: int):
        weights = Weights(often, max(documents, 3))
        self.weight, self.top = weights.__getitem__, weights.top
        self.exemplars: list[tuple[str, frozenset[str], float]] = []
        self.postings: dict[str, list[int]] = defaultdict(list)
        for label, lines in EXEMPLARS.items():
            for line in lines.strip().split("\n"):
                t = frozenset(terms(line))
                self.exemplars.append((label, t, sum(map(self.weight, t))))
        for n, (_, t, _) in enumerate(self.exemplars):
            for x in t:
                if self.weight(x) >= 0.5 * self.top:
                    self.postings[x].append(n)
        self.words = frozenset(self.postings)
        self.own = {x: self.weight(x) for _, t, _ in self.exemplars for x in t}

    def window(self, t: set[str]) -> tuple[float, str | None]:
        """(weight, label): the label of the best exemplar if it and its like contain enough of the window's terms."""
        total = sum(map(self.weight, t))
        near = {n for x in t & self.words for n in self.postings[x]}
        best: tuple[float, str | None] = (0.0, None)
        for n in near:
            label, own, size = self.exemplars[n]
            score = sum(self.weight(x) for x in t & own) / math.sqrt(total * size)
            if score > best[0]:
                best = (score, label)
        label = best[1]
        # a window may mix the wordings of several retrieved exemplars of the best one's label
        held = t & frozenset().union(*(self.exemplars[n][1] for n in near if self.exemplars[n][0] == label))
        shared = sum(map(self.weight, held))
        if label in ("error", "script") and not t.isdisjoint(MEANINGS):
            return total, None
        least = CONTAINED if t.isdisjoint(CASES) else TOLD
        return total, label if shared >= max(least * total, SHARED * self.top) else None

    def spot(self, shape: str, window: str) -> str | None:
        """The label of a shape's surroundings: that of the exemplar with the shape that contains most of the window's weight."""
        t = set(terms(window))
        best: tuple[float, float, str | None] = (0.0, 0.0, None)
        for n in self.postings.get(shape, ()):
            label, own, size = self.exemplars[n]
            if "‹weak›" in own and label == "render" and not own <= t:
                continue
            held = sum(map(self.weight, t & own))
            if (held, -size) > best[:2]:
                best = (held, -size, label)
        return best[2]

    def judge(self, text: str) -> tuple[str | None, float]:
        """(reason, coverage) of a document; no reason for a sound one."""
        if not text.strip():
            return None, 0.0
        for shape, window in shapes(text):
            label = self.spot(shape, window)
            if label in ("slot", "render"):
                return label, 1.0
        if repeated(text):
            return self.window({"‹repeat›"})[1], 1.0
        text = _REFERENCE.sub("#", text)
        if any(x in text for x in _RAISED):
            text = _EXCEPTION.sub("‹exception›", text)
        found = terms(text)
        odd = not natural(found)
        if not odd and self.words.isdisjoint(found):
            return None, 0.0
        if not odd and sum([self.own[x] for x in found if x in self.own]) < CONTAINED * COVERED * sum(map(self.weight, set(found))):
            return None, 0.0  # labelled passages hold less than this weight of exemplars' terms, with repeats
        whole, held, need = 0.0, Counter(), COVERED
        for part in _PASSAGE.split(text):
            if not part.strip():
                continue
            strange = {w for w in unnatural(part) if self.weight(w) == self.top} if odd else ()
            t = set(terms(part))
            if len(strange) >= 0.7 * len(t):  # its words are one shape
                weight, label = self.top * len(t), self.window({"‹unnatural›"})[1]
            else:
                weight, label = self.window(t)
            whole += weight
            held[label] += weight
            if label and not t.isdisjoint(CASES):
                need = TOLD
        best = max(EXEMPLARS.keys() - {"explain"}, key=lambda x: (held[x], x))
        share = sum(held[x] for x in EXEMPLARS if x != "explain") / whole if whole else 0.0
        return (best, share) if share >= need else (None, share)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by term, without those that resemble an exemplar and without unnatural passages;
    "" stands for all of them."""
    for batch in batches:
        seen: Counter[str] = Counter()
        for text in batch.column(0).to_pylist():
            listed = terms(text)
            found = set(listed)
            if not natural(listed):
                parts = [p for p in _PASSAGE.split(text) if not unnatural(p)]
                found = set(terms("\n".join(parts)))
            if found and not resembles(found):
                seen.update(found)
                seen[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["term", "n"])


FOUND = "doc_id long, reason string, coverage double"


def _judge(often: dict[str, int], documents: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(often, documents)
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reason, share = index.judge(text)
                if reason:
                    out.append((key, reason, share))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())], names=["doc_id", "reason", "coverage"]
            )

    return run


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id, reason, coverage): documents to leave out; reason is slot, render, filler, error or
    script.

    Term frequencies are counted over different texts (numbers aside) that do not resemble an
    exemplar, so a document is judged alike however many copies of it there are; only terms in more
    than one of ``RARE`` of them, whose number is bounded by RARE times the mean length, are sent to
    the tasks.  Quoted text and code are no slots.  Null, empty and blank texts never count; an empty
    table gives no rows; repeated rows are judged each; other columns are ignored.
    """
    text = documents.where("text IS NOT NULL").select(F.regexp_replace("text", "[0-9]+", "#").alias("text")).distinct()
    counted = stored(text.mapInArrow(_count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")), "terms")
    total = next((r.n for r in counted.where("term = ''").toLocalIterator()), 0)
    often = {r.term: r.n for r in counted.where(F.col("n") > total / RARE).toLocalIterator()}
    often.pop("", None)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.where("text IS NOT NULL").select("doc_id", "text").mapInArrow(_judge(often, total), FOUND.replace("long", kind, 1))


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents that are no residue, null and blank ones included, all columns kept."""
    return documents.join(residue(documents).select("doc_id"), "doc_id", "left_anti")
