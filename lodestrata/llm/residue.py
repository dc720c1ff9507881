"""Template residue, filler, error pages and script notices in place of content.

Lines are normalised (digits and names masked) and counted by host; a line that a
large share of a host's distinct texts hold is that host's boilerplate and is
subtracted.  What remains is read block by block: outside code samples and
quotations, a block with unfilled slots, with filler, or that is nothing but an
error message or a notice that scripts are needed is residue.
"""

from __future__ import annotations

import re

import ahocorasick
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage

KINDS = ("placeholder", "filler", "error", "script_required")

_FENCE = re.compile(r"(?ms)^[ \t]*(`{3,}|~{3,})[^\n]*\n.*?(?:^[ \t]*\1[ \t]*$|\Z)")
_INLINE = re.compile(r"`[^`\n]+`")
_QUOTED = re.compile(r"\"[^\"\n]{0,160}\"|“[^”\n]{0,160}”|„[^“”\n]{0,160}[“”]|«[^»\n]{0,160}»|「[^」\n]{0,160}」|『[^』\n]{0,160}』")
_BLOCKS = re.compile(r"\n[ \t]*\n+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")

# Forms of unfilled slots.
_NAME = r"[A-Za-z][\w .-]{0,40}"
_SLOT = re.compile(
    r"\{\{\s*[#/^>&!]?\s*" + _NAME + r"?\s*\}\}|(?<![\w(])\(\(\s*[A-Za-z][\w ]{1,40}\s*\)\)|\{%\s*" + _NAME + r"\s*%\}|[$#]\{\s*[A-Za-z][\w.]{0,40}\s*\}|(?<![\w$#{])\{[A-Za-z][\w]{0,40}\}(?!\})|\[\[\s*[A-Za-z][\w ]{0,40}\s*\]\]"
    r"|\[(?:INSERT|YOUR|ENTER|ADD|PLACEHOLDER|Insert|Your|Enter|Add|your|insert|enter|TODO|TBD|Name|NAME|DATE|Date|TITLE|Title)\b[^\[\]\n]{0,40}\]|\[[A-Z][A-Z_ ]{2,40}\]"
    r"|(?<![\w<])<[a-z][a-z]*(?:_[a-z]+)+>|(?<![\w<])<(?:YOUR|INSERT|your|insert|Your|Insert|ENTER|enter|Enter|ADD|add|Add)[ _-][^<>\n]{1,40}>|(?<![\w<])<(?:first|last|full|user|company|product|project|customer|model|file|author|recipient|report|run|city|street|email)[ -](?:name|title|address|number|date|id|code)>|%[A-Z_]{3,40}%|%\([a-z_]{2,40}\)[sd]|__[A-Z][A-Z_]{2,40}__|(?<!\w)@@?[A-Z_]{3,40}@@?|<%=?\s*[\w.]{2,40}\s*%>"
)
_ANGLE = re.compile(r"(?<![\w<])<([a-z]{3,20})>")
# Words of texts that talk about slots, filler or messages.
_ABOUT = re.compile(r"\b(?:slots?|placeholders?|templates?|variables?|syntax|braces|brackets|tags?|fields? named|filled|substituted|replaced by|written as|such as|called|quotes?|quoted|example|asks for|contains|saw|heading|platzhalter|vorlagen?|gabarits?|plantillas?|marcador|filled in)\b|プレースホルダ|テンプレート", re.I)
# Filler vocabulary.
FILLER = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum porta vitae lectus ornare rutrum fusce sedum vestibulum pellentesque mauris nunc vivamus praesent donec aliquam integer curabitur maecenas suspendisse ultrices posuere cubilia curae".split()
_FILLER = frozenset(FILLER)
# Keyboard and stand-in words that carry nothing; ``test`` counts beside them only.
NONSENSE = "foo bar baz qux quux blah bla asdf asdfg asdfgh sdf fgh ghjk jkl jklö qwer qwert qwerty qwertz azerty yxcv zxcv zxcvb hjkl lalala abc abcabc hoge fuga piyo ほげ ふが ぴよ".split()
_NONSENSE = frozenset(NONSENSE)
# What a whole sentence says where content is still to come.
_NOUN = r"(?:text|copy|paragraph|sentence|content|description|title|heading|headline|caption|data|block|section|body|line|image|words?|summary|name)s?"
_DUMMY = re.compile(
    "|".join((
        r"tbd|tba|tbc|todo|fixme|xx+|n\.?n\.?|\?{2,}|\.{3,}|…+|-{2,}|_{3,}|placeholder|dummy|blah(?:[ ,]+blah)*|foo(?: bar)?|asdf\w*|qwert\w*|coming soon|under construction",
        r"(?:still )?to be (?:done|added|determined|written|decided|filled(?: in)?|announced|completed|defined|provided|confirmed)(?: later)?",
        r"(?:this is )?(?:an? |the |some |your |just )?(?:dummy|placeholder|filler|stand-in) " + _NOUN + r"(?: (?:for|to|in|until|only|that|which|and|of|here)\b.{0,80})?",
        r"(?:this is )?(?:an? |some |your |just )?(?:sample|example|test|demo|temporary) " + _NOUN + r"(?: (?:goes|comes|follows) here| only)?",
        r"(?:your |the |some |more |main |body )?" + _NOUN + r" (?:(?:goes|comes|belongs|appears|will go|will be|to go|to come) )?here",
        r"(?:please )?(?:replace|change|edit|overwrite|delete|remove|rewrite|update) (?:this|these|the) (?:dummy |placeholder |sample |default |example )?" + _NOUN + r"(?: (?:before|with|by|when|once|after|later|and|on|in)\b.{0,80})?",
        r"(?:please )?(?:fill|add|insert|write|put|enter|type|paste) .{0,60}\b(?:here|below)",
        r"folgt|wird (?:noch )?(?:ergänzt|nachgereicht)|(?:dies(?:er|es)? (?:ist|text ist) )?(?:ein )?(?:blindtext|platzhaltertext|mustertext|beispieltext)\b.{0,80}|hier (?:steht|kommt|folgt|entsteht) .{0,60}|(?:diesen|den|bitte diesen) (?:text|absatz|abschnitt|satz) .{0,60}(?:ersetzen|austauschen|löschen|ergänzen)|hier .{0,40}(?:einfügen|eingeben|eintragen)",
        r"à (?:compléter|venir|remplir|définir)|(?:faux texte|texte (?:ici|à (?:remplacer|compléter|venir)|de remplissage|provisoire|factice))\b.{0,80}|(?:remplacez|remplacer|insérez|insérer|saisissez|saisir|ajoutez|écrivez) (?:ce|cette|le|la|votre|ici)\b.{0,80}",
        r"por (?:definir|completar|determinar)|pendiente|texto (?:aquí|de (?:relleno|ejemplo|prueba|muestra)|provisional|ficticio)\b.{0,80}|(?:reemplace|reemplazar|sustituya|sustituir|inserte|insertar|escriba|introduzca|añada) (?:este|esta|el|la|su|aquí)\b.{0,80}",
        r"da (?:completare|definire)|testo (?:segnaposto|di (?:esempio|riempimento|prova)|qui)\b.{0,80}|(?:sostituire|sostituisci|inserire|inserisci) (?:questo|il|qui)\b.{0,80}",
        r"(?:a|por) (?:preencher|definir)|texto (?:aqui|de (?:exemplo|preenchimento|teste))\b.{0,80}|(?:substitua|insira|digite) (?:este|o|seu|aqui)\b.{0,80}",
        r"(?:nog )?in te vullen|(?:voorbeeldtekst|opvultekst|tijdelijke tekst)\b.{0,80}|(?:vervang|vul) (?:deze|hier)\b.{0,80}",
        r"未定|後日記載|準備中|ここに.{0,30}(?:入力|記入|入れ|挿入|書).{0,20}|.{0,8}(?:ダミー|サンプル|仮の?)(?:テキスト|文章|文|データ).{0,30}|この(?:文|文章|テキスト|段落|部分).{0,30}(?:置き換え|差し替え|入れ替え|削除).{0,20}|.{0,10}(?:テキスト|文章|本文)が入ります",
    )),
    re.I,
)
_LABEL = re.compile(r"[\w /-]{1,40}:\s+")
_SAME = re.compile(r"\b([^\W\d_])\1+\b")

# Notices that scripts are needed, by language: pieces of which a text needs one, and the pattern that is then tried.
_SCRIPT_WORD = r"(?:java ?script|scripts?|scripting|cookies)"
_SCRIPT = (
    (("script", "cookie"), _SCRIPT_WORD + r"[^.!?\n]{0,60}\b(?:required|needed|necessary|disabled|switched off|turned off|blocked|not (?:enabled|supported|available|allowed|active)|must be|(?:is|are|has|have) to be|should be|isn't|aren't|off)\b"),
    (("script", "cookie"), r"\b(?:needs?|requires?|relies on|depends on|without|uses)\b[^.!?\n]{0,30}" + _SCRIPT_WORD),
    (("script", "cookie"), r"\b(?:enable|activate|allow|turn on|switch on|unblock|permit)\b[^.!?\n]{0,30}" + _SCRIPT_WORD),
    (("script", "cookie"), r"\bdoes(?: not|n't) (?:run|support|execute|allow) [^.!?\n]{0,20}" + _SCRIPT_WORD),
    (("browser", "reload", "will not", "switch"), r"\bchecking your browser\b|\b(?:viewer|page|site|app)\b[^.!?\n]{0,20}\bwill not (?:work|load|run)\b|\bswitch (?:it|them) on and reload\b|\breload (?:the page|to see)"),
    (("script", "skript"), r"java ?script[^.!?\n]{0,40}\b(?:aktivier\w*|erforderlich|benötigt|einschalten|deaktiviert|ausgeschaltet|zulassen)|\b(?:aktivieren|benötigt|erfordert|erlauben|schalten)\b[^.!?\n]{0,40}(?:java ?script|skripte?)|\bskripte?\b[^.!?\n]{0,30}\b(?:erforderlich|nötig|aktivier\w*|deaktiviert|zulassen)"),
    (("script",), r"\b(?:activer|activez|nécessite|requiert|autoriser|autorisez|exige)\b[^.!?\n]{0,40}(?:java ?script|scripts)|java ?script[^.!?\n]{0,40}\b(?:activé|désactivé|requis|nécessaire|activer)"),
    (("script",), r"\b(?:active|activar|activa|habilite|habilita|habilitar|requiere|necesita|permita)\b[^.!?\n]{0,40}java ?script|java ?script[^.!?\n]{0,40}\b(?:desactivado|activado|necesario|requerido|habilitado|deshabilitado)"),
    (("script",), r"\b(?:attiva|attivare|attivate|abilita|abilitare|abilitate|richiede|consenti|consentire|necessita)\b[^.!?\n]{0,40}(?:java ?script|gli script)|java ?script[^.!?\n]{0,40}\b(?:disabilitato|disattivato|necessario|richiesto|abilitato|attivato)"),
    (("script",), r"\b(?:ative|ativar|habilite|habilitar|permita|permitir|requer|precisa|exige)\b[^.!?\n]{0,40}(?:java ?script|scripts)|java ?script[^.!?\n]{0,40}\b(?:desativado|desabilitado|necessário|ativado|habilitado)"),
    (("script",), r"\b(?:schakel|zet|activeer|vereist|sta|nodig)\b[^.!?\n]{0,40}(?:java ?script|scripts)|java ?script[^.!?\n]{0,40}\b(?:uitgeschakeld|ingeschakeld|vereist|nodig|geactiveerd|staat uit)"),
    (("javascript", "スクリプト"), r"javascript[^。\n]{0,20}(?:有効|必要|無効|オン|許可)|スクリプト[^。\n]{0,20}(?:有効|必要|無効|許可)"),
)
# Error messages of servers and programs, by language, in the same form.
_ERROR = (
    (("4", "5"), r"^\W*(?:http |status |error |code )*(?:4\d\d|5\d\d)\b(?! \w+(?: \w+){6,})"),
    (("err", "fehler", "エラー"), r"\b(?:error|fehler|erreur|erro|errore)\W{0,3}(?:code |nr\.? |n° )?(?:\d{3}\b|0x[0-9a-f]+)|エラー\W{0,3}\d{3}"),
    (("found", "exist"), r"\bpage not found\b|\bnot found on this server\b|\bdoes not exist on this server\b"),
    (("asked for", "requested", "looking for"), r"\b(?:page|file|document|resource|report|url) (?:you (?:asked for|requested|are looking for|were looking for)|requested)\b"),
    (("not be ", "n't be "), r"\b(?:could not|cannot|can't|couldn't|can not) be (?:found|displayed|loaded|shown|reached|opened|rendered)\b"),
    (("denied", "forbidden", "authori", "have"), r"\baccess (?:is |was )?denied\b|\bpermission denied\b|\bforbidden\b|\bunauthori[sz]ed\b|\b(?:do|does) not have (?:the )?(?:rights?|permission|access)\b"),
    (("session", "in again"), r"\bsession (?:has |is )?(?:expired|timed out)\b|\b(?:sign|log) in again\b"),
    (("temporarily", "currently", "maintenance", "please", "try again", "back in"), r"\b(?:temporarily|currently) (?:unavailable|out of service|down)\b|\bunder maintenance\b|\bplease (?:come back|try again|retry)\b|\btry again (?:later|in)\b|\bback in \d+ minutes\b"),
    (("time", "gateway", "connection"), r"\b(?:gateway|request|connection) time-?(?:out|d out)\b|\btimeout after\b|\bbad gateway\b|\bconnection (?:refused|reset|lost|closed)\b"),
    (("error", "wrong", "oops", "too many", "rate limit"), r"\binternal (?:server )?error\b|\bunexpected error\b|\bwent wrong\b|\boops\b|\berror (?:has )?occurred\b|\btoo many requests\b|\brate limit exceeded\b"),
    (("fatal", "warning", "uncaught", "unhandled", "exception", "traceback", "error"), r"^\W*(?:fatal|warning|uncaught|unhandled|exception|traceback|error)\b\W|\btraceback \(most recent\b"),
    (("error", "exception", "notfound"), r"\b\w+(?:Error|Exception|NotFound)\b\s*[:(]"),
    (("trace", "fault", "dump", "pointer", "undefined", "syntax", "no such", "template", "render"), r"\bstack ?trace\b|\b(?:segmentation fault|core dumped|null ?pointer|undefined index|syntax error|no such file)\b|\b(?:template|render(?:ing)?) (?:error|failed)\b"),
    (("find", "locate", "load", "open ", "display", "reach", "show", "access", "retrieve", "process", "connect", "render"), r"\b(?:can(?:'t|’t|not| not)|could(?:n't|n’t| not)|unable to|failed to) (?:find|locate|load|open|display|reach|show|access|retrieve|process|connect to|render) (?:(?:that|this|the|your|a|any) )?(?:\w+ )?(?:page|file|document|resource|report|url|address|site|server|record|request|content|image|app|application|link|host|database)\b"),
    (("moved", "deleted", "removed", "renamed", "no longer"), r"\b(?:may|might|could|must) have been (?:moved|deleted|removed|renamed)\b|\b(?:moved|removed|renamed) or (?:deleted|removed|renamed)\b|\bno longer (?:exists|available)\b"),
    (("maintenance", "offline", "shortly", "be back"), r"\b(?:down|offline|closed|unavailable) for (?:\w+ )?(?:maintenance|repairs?|upgrades?)\b|\b(?:scheduled|planned|undergoing) maintenance\b|\bis (?:currently )?offline\b|\bback (?:soon|shortly|online)\b"),
    (("service", "bad request", "invalid request", "too many", "redirect", "administrator", "trouble", "problem"), r"\bservice (?:is )?unavailable\b|\b(?:bad|invalid) request\b|\btoo many redirects\b|\bcontact (?:the|your) (?:\w+ )?administrator\b|\b(?:trouble|problems?) (?:loading|displaying|opening|connecting)\b"),
    (("seite", "zugriff", "fehler", "versuchen", "abgelaufen", "verfügbar", "erreichbar", "angeforderte", "wartung", "berechtigung", "gelöscht", "auffindbar", "gefunden", "erneut"), r"\bseite (?:wurde |existiert |ist )?nicht (?:gefunden|mehr|auffindbar|erreichbar|vorhanden)\b|\bseite existiert nicht\b|\bnicht gefunden werden\b|\bzugriff (?:wurde |ist )?verweigert\b|\bein (?:interner |unerwarteter )?fehler\b|\b(?:ist|sind) (?:ein )?fehler aufgetreten\b|\bversuchen sie es (?:später|erneut|noch einmal|bitte)\b|\b(?:sitzung|anmeldung) (?:ist )?abgelaufen\b|\bnicht (?:verfügbar|erreichbar)\b|\bdie angeforderte\b|\bwartungsarbeiten\b|\b(?:in|wegen) wartung\b|\bkeine berechtigung\b|\bverschoben oder gelöscht\b|\bmelden sie sich (?:bitte )?erneut\b"),
    (("erreur", "introuvable", "accès", "réessay", "expir", "survenue", "indisponible", "existe pas", "trouv", "maintenance", "droits", "supprim", "reconnect"), r"\bune erreur\b|\b(?:page|fichier|document) (?:est )?introuvable\b|\baccès (?:refusé|interdit)\b|\bréessay(?:ez|er)\b|\bsession (?:a |est )?expiré|\best survenue\b|\bindisponible\b|\bn['’]existe (?:pas|plus)\b|\bn['’]a pas (?:pu )?(?:être|été) trouvé|\ben (?:cours de )?maintenance\b|\bn['’]avez pas (?:les droits|le droit|la permission|accès)\b|\bdéplacée? ou supprimée?\b|\b(?:vous )?reconnecte[rz]\b"),
    (("error", "página", "archivo", "acceso", "int", "sesión", "disponible", "no se", "mantenimiento", "permiso", "eliminad"), r"\b(?:se )?ha (?:ocurrido|producido) un error\b|\b(?:página|archivo) no (?:encontrad[ao]|existe)\b|\bacceso denegado\b|\binténtelo? (?:de nuevo|más tarde|nuevamente)\b|\bvuelva a intentarlo\b|\bsesión (?:ha )?(?:caducado|expirado)\b|\bno (?:está )?disponible\b|\bno se (?:encontró|pudo|ha encontrado|ha podido|puede mostrar)\b|\ben mantenimiento\b|\bno tiene (?:permisos?|acceso)\b|\b(?:movid|eliminad)[ao] o (?:movid|eliminad)[ao]\b"),
    (("pagina", "accesso", "errore", "riprova", "sessione", "manutenzione", "disponibile", "esiste"), r"\bpagina (?:non (?:è stata )?(?:trovata|esiste|disponibile))\b|\baccesso (?:negato|vietato)\b|\bsi è verificato un errore\b|\briprova(?:re|te)? (?:più tardi|di nuovo|tra)\b|\bsessione (?:è )?scaduta\b|\bin manutenzione\b|\bnon (?:è )?disponibile\b|\bnon esiste (?:più )?su\b"),
    (("página", "acesso", "erro", "tente", "sessão", "manutenção", "indispon"), r"\bpágina não (?:foi )?(?:encontrada|existe)\b|\bacesso negado\b|\b(?:ocorreu|aconteceu) um erro\b|\btente (?:novamente|de novo|mais tarde)\b|\bsessão (?:foi )?expir|\bem manutenção\b|\bindisponível\b|\bpágina não existe\b"),
    (("pagina", "toegang", "fout", "probeer", "sessie", "onderhoud", "beschikbaar"), r"\bpagina (?:is |kon )?niet (?:gevonden|worden gevonden|beschikbaar)\b|\btoegang (?:is )?geweigerd\b|\b(?:er is )?(?:een|iets) fout (?:opgetreden|gegaan)\b|\bprobeer het (?:later |nog eens |opnieuw)|\bsessie (?:is )?verlopen\b|\b(?:in|wegens|voor) onderhoud\b|\bniet beschikbaar\b|\bbestaat niet (?:meer )?op\b"),
    (("エラー", "ません", "アクセス", "もう一度", "再度", "セッション", "メンテ", "しばらく", "削除", "ログイン"), r"エラーが発生|見つかりません|アクセスが(?:拒否|禁止)|アクセス権|後でもう一度|再度お試し|セッション(?:の有効期限|が切れ)|(?:利用|表示|接続)できません|メンテナンス中|メンテナンスのため|しばらくして|権限がありません|移動(?:または|、|か)削除|再度ログイン|ログインし直"),
)


def _rules(table: tuple) -> list[tuple[tuple[str, ...], re.Pattern]]:
    return [(pieces, re.compile(text, re.I | re.M)) for pieces, text in table]


_SCRIPT_RULES, _ERROR_RULES = _rules(_SCRIPT), _rules(_ERROR)
# Pieces of which every sentence that ``_DUMMY`` matches has one.
_DUMMY_PIECES = "tbd|tba|tbc|todo|fixme|xx|nn|n.n|??|...|…|--|__|placeholder|dummy|blah|foo|asdf|qwert|coming soon|under construction|to be |filler |stand-in|sample |example |test |demo |temporary | here|replace |change |edit |overwrite |delete |remove |rewrite |update | below|folgt|wird |blindtext|platzhalter|mustertext|beispieltext|hier |ersetzen|austauschen|löschen|ergänzen|à |texte |remplac|insér|saisi|ajoutez|écrivez|por |pendiente|texto |reempla|sustitu|inserte|insertar|escriba|introduzca|añada|da com|da def|testo |sostitui|inserir|inserisci|a preencher|a definir|substitua|insira|digite|te vullen|voorbeeldtekst|opvultekst|tijdelijke|vervang |vul |未定|後日|準備中|ここに|ダミー|サンプル|仮|この|入ります".split("|")
_SAME_START = [f" {c}{c}" for c in "abcdefghijklmnopqrstuvwxyzäöüあアｘ"]


def _piece_index() -> ahocorasick.Automaton:
    """All pieces with what they make worth trying: (0, n) a script rule, (1, n) an error rule, (2, 0) filler by words, (3, 0) sentences that only announce content."""
    uses: dict[str, set[tuple[int, int]]] = {}
    for table, rules in enumerate((_SCRIPT_RULES, _ERROR_RULES)):
        for n, (pieces, _) in enumerate(rules):
            for p in pieces:
                uses.setdefault(p, set()).add((table, n))
    for w in [*(w for w in FILLER if len(w) > 3), *NONSENSE, *_SAME_START]:
        uses.setdefault(w, set()).add((2, 0))
    for p in _DUMMY_PIECES:
        uses.setdefault(p, set()).add((3, 0))
    index = ahocorasick.Automaton()
    for p, u in uses.items():
        index.add_word(p, frozenset(u))
    index.make_automaton()
    return index


_PIECES = _piece_index()


def _says(rules: list[tuple[tuple[str, ...], re.Pattern]], sentence: str, low: str) -> bool:
    """True where a rule one of whose pieces the sentence has finds its pattern."""
    for pieces, pattern in rules:
        for p in pieces:
            if p in low:
                if pattern.search(sentence):
                    return True
                break
    return False


_WORD = re.compile(r"[^\W\d_]+")
_MARKUP = re.compile(r"</?[a-z][^<>]*>")
_SIGN = re.compile(r"[{\[<%_@]|\(\(")
_EDGE = " \t\r\n#*->_=|"


def _filler_words(low: str) -> bool:
    """True where filler words, keyboard words or words of one repeated letter make up most of a text in lower case."""
    words = _WORD.findall(low)
    known = sum(w in _FILLER for w in words)
    if len(words) >= 4 and known >= 0.6 * len(words) and sum(w in _FILLER and len(w) > 3 for w in words) >= 0.35 * len(words):
        return True
    empty = sum(w in _NONSENSE for w in words)
    if len(words) >= 3 and empty >= 0.35 * len(words) and empty + words.count("test") >= 0.6 * len(words):
        return True
    return len(words) >= 3 and len(_SAME.findall(low)) >= 0.6 * len(words)


def _is_dummy(sentence: str) -> bool:
    """True where a sentence, its label left out, only says that content is to come."""
    bare = sentence.strip(_EDGE).rstrip(".!。 \t") or sentence.strip()
    if _DUMMY.fullmatch(bare):
        return True
    label = _LABEL.match(bare)
    return bool(label and _DUMMY.fullmatch(bare[label.end() :].strip()))


def _is_filler(block: str, low: str, hits: set[tuple[int, int]]) -> bool:
    if (2, 0) in hits and _filler_words(low):
        return True
    if (3, 0) not in hits:
        return False
    parts = _parts(block)
    other = 0
    for s in parts:
        other += not _is_dummy(s)
        if other > 0.5 * len(parts):
            return False  # too few are left to be half of the block
    return True


def _parts(block: str) -> list[str]:
    return [s for s in (x.strip() for x in _SENTENCE.split(block)) if s]


def residue_kinds(text: str | None, boiler: frozenset[int] | None = None) -> list[str]:
    """Kinds of residue of a text, its host's boilerplate lines subtracted; null and empty texts have none.

    One pass over each block finds the pieces it has; only rules with a piece are
    then tried, on every sentence, whatever its length or the block's.
    """
    if not text or not text.strip():
        return []
    bare = _FENCE.sub("\n\n", text) if "```" in text or "~~~" in text else text
    found = set()
    for block in _BLOCKS.split(bare):
        if boiler:
            block = "\n".join(x for x in block.split("\n") if line_hash(x) not in boiler)
        if not block.strip():
            continue
        low = block.lower()
        hits: set[tuple[int, int]] = set().union(*{use for _, use in _PIECES.iter(" " + low.replace("\n", " ") + " ")})
        if _is_filler(block, low, hits):
            found.add("filler")
            continue
        plain = _INLINE.sub("", block) if "`" in block else block
        if _SIGN.search(plain) and (_SLOT.search(plain) or _ANGLE.search(plain)):
            for s in _parts(plain):
                if (_SLOT.search(s) or _ANGLE.search(s) and _slot_angles(block)) and not _ABOUT.search(_SLOT.sub("", s)):
                    found.add("placeholder")
                    break
        scripts, errors = ([rules[n] for t, n in sorted(hits) if t == table] for table, rules in enumerate((_SCRIPT_RULES, _ERROR_RULES)))
        if not scripts and not errors:
            continue
        sentences = _parts(_MARKUP.sub(" ", _QUOTED.sub('""', plain)))
        script = error = 0
        for n, sentence in enumerate(sentences):
            if '""' not in sentence:
                low = sentence.lower()
                is_script = _says(scripts, sentence, low)
                script += is_script
                error += not is_script and _says(errors, sentence, low)
            if n + 1 - script - error > 0.5 * len(sentences):
                break  # too few are left to be half of the block
        if sentences and script + error >= 0.5 * len(sentences):
            found.add("script_required" if script >= error else "error")
    return [k for k in KINDS if k in found]


def _slot_angles(block: str) -> bool:
    """True where ``<word>`` forms in a block are slots, not markup: none is closed, and words stand between them."""
    names = _ANGLE.findall(block)
    return bool(names) and not re.search(r"</|/>|<\w+ [\w:-]+=", block)


_CAPITAL = re.compile(r"(?<!^)\b[A-Z][a-z]+\b")
_DIGITS = re.compile(r"\d+")


def normal_line(line: str) -> str:
    """The line with white space squeezed, digits as 0 and capitalised words inside as N."""
    return _CAPITAL.sub("N", _DIGITS.sub("0", " ".join(line.split())))


def _normal(line: Column) -> Column:
    """``normal_line`` as a column expression, for counting on the JVM."""
    squeezed = F.trim(F.regexp_replace(line, r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", " "))
    return F.regexp_replace(F.regexp_replace(squeezed, r"\d+", "0"), r"(?<!^)\b[A-Z][a-z]+\b", "N")


def host_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", share: float = 0.3, least: int = 20) -> DataFrame:
    """(``host_key``, ``lines``): hashes of the normalised lines that at least ``share`` of a host's distinct texts, and at least ``least`` of them, hold.

    Counted over all documents, by 64-bit hashes of texts and lines, so that no text
    is shuffled.  The list of a host is short by construction: its lines each need
    that share, so it holds at most (lines per text) / share.
    """
    texts = docs.select(F.col(host).cast("string").alias("host_key"), F.col(text).alias("t")).filter(F.col("t").isNotNull()).withColumn("id", F.xxhash64("t"))
    lines = texts.select("host_key", "id", F.explode(F.split("t", r"\r?\n")).alias("line")).filter(F.length(F.trim("line")) > 0)
    holders = lines.select("host_key", "id", F.xxhash64(_normal(F.col("line"))).alias("line")).distinct().groupBy("host_key", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    sizes = texts.select("host_key", "id").distinct().groupBy("host_key").agg(F.count("*").alias("texts"))
    often = holders.join(sizes, holders["host_key"].eqNullSafe(sizes["host_key"])).filter(F.col("n") >= share * F.col("texts"))
    return often.groupBy(holders["host_key"].alias("host_key")).agg(F.collect_set("line").alias("lines"))


def line_hash(line: str) -> int:
    """The hash that ``host_boilerplate`` gives a line."""
    h = xxhash.xxh64_intdigest(normal_line(line), seed=42)
    return h - (1 << 64) if h >> 63 else h


def find_residue(docs: DataFrame, key: str, host: str = "source", text: str = "text", share: float = 0.3, least: int = 20, most_broadcast: int = 500_000) -> DataFrame:
    """(``key``, ``kinds``): every document of which at least one block is residue.

    The boilerplate of all hosts is broadcast where it has at most ``most_broadcast``
    lines, so that no text is shuffled; beyond that, it is joined by shuffle.

    Nulls, empty and tiny texts are no residue; a null host is a host of its own;
    repeated documents each give their own row.
    """
    boiler = stage(host_boilerplate(docs, host, text, share, least), "boilerplate")
    listed = boiler.agg(F.coalesce(F.sum(F.size("lines") + 8), F.lit(0))).first()[0]
    if listed <= most_broadcast:  # 8 bytes a line: at most a few MB
        boiler = F.broadcast(boiler)
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("doc_key"), F.col(host).cast("string").alias("h"), F.col(text).alias("t")).filter(F.length(F.trim("t")) > 0)
    joined = rows.join(boiler, F.col("h").eqNullSafe(F.col("host_key")), "left").select("doc_key", "t", "lines")

    def run(batches):
        for b in batches:
            out = [(k, kinds) for k, t, lines in zip(b["doc_key"], b["t"], b["lines"]) if (kinds := residue_kinds(t, None if lines is None else frozenset(lines)))]
            yield pd.DataFrame(out, columns=["doc_key", "kinds"])

    return joined.mapInPandas(run, f"doc_key {kind}, kinds array<string>").select(F.col("doc_key").alias(key), "kinds")
