"""Which language a short text is in, from scripts, function words and letters.

Names, numbers and codes are to be ignored, so only words that begin in lower
case count in scripts with case.  The word lists are function words and a few
very common verbs; a language is only reported where it leads clearly.
"""

from __future__ import annotations

import re
from collections import Counter

# Function words by language: articles, pronouns, prepositions, conjunctions, auxiliaries and adverbs of place, time and degree; no words of any subject.
WORDS = {
    "en": "the a an of and to in is was were are be been being am do does did have has had having will would shall should can cannot could may might must not no nor neither either or but if then than that this these those which who whom whose what when where why how while because although though since until unless as at by for from with without within into onto upon over under between among through during before after above below against about across along around behind beside near off out up down again all any both each every few many more most much other others another some such only own same so too very just also still yet ever never always often here there now i me my we us our you your he him his she her it its they them their one two three first last please let yes",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber denn sondern doch ist sind war waren sei wird werden wurde wurden worden hat haben hatte hatten bin bist kann können konnte muss müssen musste soll sollen darf dürfen will wollen mag möchte nicht kein keine keinen keiner nichts nie niemals nur noch schon auch sehr mehr immer wieder hier dort da dann wenn als wie ob dass daß weil damit obwohl während bis seit mit ohne für von vom zu zum zur im in am an auf aus bei beim nach vor über unter durch gegen um zwischen neben hinter ich du er sie es wir ihr mich mir dich dir ihn ihm uns euch ihnen man sich mein dein sein seine seinen ihre unser dieser diese dieses diesen diesem jeder jede jedes alle allen alles welche welcher einige viele beide zwei drei erst bevor nachdem jetzt heute gestern morgen bitte so ja nein zurück außerhalb",
    "fr": "le la les l un une des du de d et ou mais donc or ni car que qui quoi dont où si est sont était étaient être été suis sommes a ont avait avaient avoir ai avons peut peuvent doit doivent fait ne pas plus jamais rien aucun aucune personne seulement seul seule très trop aussi encore déjà toujours souvent ici là avec sans pour par dans sur sous en au aux à chez vers entre avant après pendant depuis jusque contre près je tu il elle on nous vous ils elles me te se lui leur y ce cet cette ces cela ceci mon ma mes ton ta tes son sa ses notre nos votre vos leurs tout tous toute toutes chaque quelque quelques plusieurs deux trois comme quand lorsque parce puis alors ainsi désormais maintenant hier aujourd demain oui non hors dehors",
    "es": "el la los las un una unos unas lo al del de y e o u pero sino ni que quien quienes cual cuales cuyo donde cuando como si es son era eran ser sido fue fueron soy está están estaba estar ha han había haber he hay tiene tienen puede pueden debe deben no nunca jamás nada nadie ningún ninguna sólo solo solamente muy más menos mucho muchos también tampoco ya aún todavía siempre aquí allí ahí ahora ayer hoy mañana antes después luego entonces con sin para por en a ante bajo sobre entre hasta desde hacia según contra junto fuera dentro yo tú él ella usted nosotros ellos ellas me te se nos le les su sus mi mis tu tus este esta estos estas ese esa esos esas aquel aquella esto eso todo todos toda todas cada algún alguno alguna algunos otro otra otros dos tres porque aunque mientras pues así sí",
    "pt": "o a os as um uma uns umas do da dos das no na nos nas ao aos à às pelo pela pelos pelas de em e ou mas nem que quem qual quais cujo onde quando como se é são era eram ser sido foi foram está estão estava estar há tem têm tinha ter pode podem deve devem não nunca jamais nada ninguém nenhum nenhuma só somente apenas muito muitos mais menos também já ainda sempre aqui ali lá agora ontem hoje amanhã antes depois então com sem para por ante sob sobre entre até desde contra dentro fora abaixo ao eu tu ele ela você nós eles elas me te lhe seu sua seus suas meu minha este esta estes estas esse essa isto isso aquele aquela todo todos toda todas cada algum alguma alguns outro outra outros dois duas três porque embora enquanto pois assim sim",
    "it": "il lo la l i gli le un uno una del dello della dei degli delle al allo alla ai agli alle dal dallo dalla dai dagli dalle nel nello nella nei negli nelle sul sullo sulla sui sugli sulle di a da in con su per tra fra e ed o oppure ma però né che chi cui quale quali dove quando come se è sono era erano essere stato stata stati ha hanno aveva avere ho può possono deve devono non mai niente nulla nessuno nessuna solo soltanto molto molti più meno anche già ancora sempre qui qua lì là ora adesso ieri oggi domani prima dopo poi allora senza sotto sopra contro dentro fuori vicino ecco io tu lui lei noi voi loro mi ti si ci ce vi ve gli ne mio mia tuo suo sua suoi sue nostro questo questa questi queste quello quella quelli tutto tutti tutta tutte ogni qualche alcuni altro altra altri due tre perché mentre così sì",
    "nl": "de het een en of maar want dus noch dat die dit deze wie wat welke waar wanneer hoe als is zijn was waren wordt worden werd werden geworden ben bent heeft hebben had hadden kan kunnen kon moet moeten mag mogen zal zullen zou wil willen niet geen nooit niets niemand alleen slechts zeer veel meer minder ook al nog steeds altijd hier daar er nu toen gisteren vandaag morgen voor voordat na nadat dan met zonder voor van vanaf in op aan uit bij naar over onder boven door tegen om tussen naast achter tot te ten ter ik jij je hij zij ze wij we jullie u mij me hem haar ons hen hun zich mijn jouw iedereen iemand elk elke alle alles enkele sommige andere twee drie omdat hoewel terwijl zo ja nee",
    "sv": "och att det den de som en ett är var varit vara på av för med till från i om har hade kan kunde ska skulle måste inte ingen inget aldrig bara mycket mer också redan än alltid här där nu då igår idag efter före utan under över mellan mot vid hos ut upp ner jag du han hon vi ni dem mig dig honom henne oss sig min din sin vår denna detta dessa alla varje några andra två tre men eller när hur vad vem eftersom så ja nej",
    "da": "og at det den de som en et er var været være på af for med til fra i om har havde kan kunne skal skulle må ikke ingen intet aldrig kun meget mere også allerede endnu altid her der nu da igår efter før uden under over mellem mod ved hos ud op ned jeg du han hun vi I dem mig dig ham hende os sig min din sin vores denne dette disse alle hver nogle andre to tre men eller når hvor hvad hvem fordi så ja nej blev blevet",
    "pl": "i oraz w we na z ze do od dla po pod nad przez przy bez o u nie że się jest są był była było były być ma mają miał może można musi ten ta to te ci tego tej tym ja ty on ona my wy oni mnie ciebie jego jej nas was ich mój swój jak kiedy gdzie co kto który która które ale lub albo więc bo gdy jeśli tylko już jeszcze też bardzo zawsze nigdy tu tutaj tam teraz wczoraj przed dwa trzy wszystkie wszystko każdy",
    "cs": "a i v ve na z ze do od pro po pod nad přes při bez o u ne že se si je jsou byl byla bylo byli být má mají může musí ten ta to ti tento tato já ty on ona my vy oni mě tebe jeho její nás vás jejich můj svůj jak kdy kde co kdo který která které ale nebo tedy protože když jestli jen už ještě také velmi vždy nikdy zde tam teď včera před dva tři všechny vše každý",
    "tr": "ve veya ya da de ile ama fakat çünkü ki bir bu şu o bunlar için gibi kadar göre sonra önce üzerinde altında arasında olarak olan değil var yok ne kim nerede nasıl neden daha çok en az her hiç bazı tüm hepsi ben sen biz siz onlar benim senin onun bizim sadece burada orada şimdi dün bugün iki üç",
    "fi": "ja sekä tai mutta vaan koska kun jos että on ovat oli olivat olla ole ei eivät en se ne tämä tuo hän he minä sinä me te minun sinun hänen meidän kuka mikä missä milloin miten kuin myös vain jo vielä aina koskaan täällä tässä siellä nyt eilen ennen jälkeen ilman kanssa alla päällä välissä kaikki joka muu kaksi kolme",
    "ro": "și sau dar nici că să în la cu de pe din pentru prin sub peste între fără după înainte către nu este sunt era erau fi fost am ai are au avea poate trebuie un o unei unui al ale lui ei lor eu tu el ea noi voi acest această aceste acel care ce cine unde când cum mai foarte tot toți toate fiecare alt alți doi două trei numai doar aici acolo acum ieri",
}
# Letters that hardly occur in the other languages of the list.
LETTERS = {"de": "ß", "es": "ñ¿¡", "pt": "ãõ", "fr": "œ", "sv": "å", "pl": "ąęłńśźż", "cs": "ěřů", "tr": "ğış", "ro": "ăâîșț"}
# First and last letter of scripts by language.
SCRIPTS = {"ko": "가-힣", "ru": "Ѐ-ӿ", "el": "Ͱ-Ͽ", "ar": "؀-ۿ", "he": "֐-׿", "hi": "ऀ-ॿ", "th": "฀-๿"}
# Names of languages in queries.
NAMES = {
    "en": "english englisch anglais inglés inglês inglese 英語",
    "de": "german deutsch allemand alemán alemão tedesco ドイツ語",
    "fr": "french französisch français francés francês francese フランス語",
    "es": "spanish spanisch espagnol español espanhol spagnolo スペイン語",
    "pt": "portuguese portugiesisch portugais portugués português portoghese ポルトガル語",
    "it": "italian italienisch italien italiano イタリア語",
    "nl": "dutch niederländisch holländisch néerlandais neerlandés holandés holandês olandese オランダ語",
    "ja": "japanese japanisch japonais japonés japonês giapponese 日本語",
    "zh": "chinese chinesisch chinois chino chinês cinese 中国語",
    "ko": "korean koreanisch coréen coreano 韓国語",
    "ru": "russian russisch russe ruso russo ロシア語",
}

_BY_WORD: dict[str, list[str]] = {}
for _lang, _words in WORDS.items():
    for _w in set(_words.split()):
        _BY_WORD.setdefault(_w, []).append(_lang)
_BY_LETTER = {c: lang for lang, cs in LETTERS.items() for c in cs if sum(c in x for x in LETTERS.values()) == 1}
_LETTERS = re.compile(f"[{''.join(_BY_LETTER)}]")
_BY_NAME = {w: lang for lang, ws in NAMES.items() for w in ws.split()}
_NAMED = re.compile("|".join(map(re.escape, sorted(_BY_NAME, key=len, reverse=True))), re.I)
_TOKEN = re.compile(r"[^\W\d_]+")
_KANA = re.compile("[ぁ-ヿ]")
_HAN = re.compile("[一-鿿]")
_SCRIPT = {lang: re.compile(f"[{r}]") for lang, r in SCRIPTS.items()}
_NON_LATIN = re.compile("[Ͱ-ӿ֐-ۿऀ-ॿ฀-๿ぁ-ヿ一-鿿가-힣]")


def votes(text: str) -> Counter:
    """Evidence by language: shared words count in parts, letters twice, scripts by character."""
    out: Counter = Counter()
    if not text.isascii() and _NON_LATIN.search(text):
        kana, han = len(_KANA.findall(text)), len(_HAN.findall(text))
        if kana:
            out["ja"] += (kana + han) / 3
        elif han:
            out["zh"] += han / 3
        for lang, pattern in _SCRIPT.items():
            n = len(pattern.findall(text))
            if n:
                out[lang] += n / 4
    for word, n in Counter(_TOKEN.findall(text)).items():
        langs = _BY_WORD.get(word)
        if langs:
            for lang in langs:
                out[lang] += n / len(langs)
    if not text.isascii():
        for c in _LETTERS.findall(text):
            out[_BY_LETTER[c]] += 2
    return out


def leading(counts: Counter, least: float = 1.0, factor: float = 1.5) -> str | None:
    """The language ahead of the next by a factor, or None."""
    top = counts.most_common(2)
    if not top or top[0][1] < least or len(top) > 1 and top[0][1] < factor * top[1][1]:
        return None
    return top[0][0]


def asked_for(text: str) -> set[str]:
    """Languages that a text names."""
    return {_BY_NAME[m.lower()] for m in _NAMED.findall(text)}
