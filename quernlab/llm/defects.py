"""Problem 1: outputs that do not serve their instruction.

Ordered rules look at emptiness, copied instructions, refusals, the language of the answer, unclosed
delimiters and abrupt endings; every rule that fires is reported, and the first of the order is the
row's defect. Whether an ending without a full stop is abrupt is judged by how often its last words
end a sentence anywhere in the table, and by whether its last word is mostly the beginning of longer
ones. The endings in question name the contexts they ask for; all rows count these exactly, by a
shuffle. A bit array of fixed size keeps most contexts that nobody asks for out of the shuffle; the
counts do not depend on it.
"""

from __future__ import annotations

import ast
import html
import re
import unicodedata
import warnings
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlab.functions.sketch import TOKEN_CACHE, mix64
from quernlab.llm.arrow import sliced
from quernlab.llm.syntax.lexer import PREMATURE, UNTERMINATED, scan_python
from quernlab.operators.skew import spread_join
from quernlab.session import materialise

DEFECTS = ("empty", "copied_question", "refusal", "wrong_language", "truncated")
#: Bits of the array of contexts that are asked for.
ASKED_BITS = 23
#: A text that merely lacks its full stop always ends where a sentence may; one that was cut ends at any
#: of some seventy characters. So an ending is complete if a sentence ends there in this share of cases.
END_SHARE = 0.04
#: A context of few cases leans on the next shorter one, which weighs as much as so many cases. A word
#: never seen is taken to end a sentence in this share of cases.
LEAN, UNSEEN = 10.0, 0.2
#: A word is the beginning of others if so many have begun with it, and hardly any were the word itself.
BEGUN, BEGUN_AFTER, ITSELF = 10, 10, 0.02

# Words that stand for a missing answer or only announce one, in several languages.
PLACEHOLDERS = frozenset(
    """todo|to do|tbd|tba|to be done|to be determined|n a|na|no answer|no response|no output|no solution|empty|blank|placeholder|fixme|xxx|lorem ipsum|
    answer|the answer|response|solution|output|result|results|reply|code|your answer|your answer here|your code here|insert answer here|answer here|write your answer here|
    antwort|lösung|ausgabe|keine antwort|leer|réponse|reponse|solution|sortie|pas de réponse|vide|respuesta|solución|solucion|salida|sin respuesta|vacío|
    risposta|soluzione|nessuna risposta|resposta|solução|sem resposta|ответ|решение|вывод|нет ответа|пусто|答案|回答|答|解答|输出|无|无答案|暂无|空|待办|答え|なし""".replace("\n", "").replace("    ", "").split("|")
)
# How an answer declines, in several languages: some of the parts before a phrase are in every text that has the phrase.
REFUSALS = (
    # English
    ("sorry|afraid|apologi|apologies|unfortunately|regrettably", r"\b(?:i(?:'m| am)? (?:really |very |truly |so |deeply )?(?:sorry|afraid|apologi[sz]e)|apologies|my apologies|sorry|unfortunately|regrettably)\b[^.!?:]{0,40}\b(?:i|we|not|can't|cannot|unable|declin\w+|refus\w+)\b[^.!?]{0,80}?(?:\b(?:can't|cannot|can not|could not|won't|will not|unable|decline|refuse|not (?:able|allowed|permitted|authori[sz]ed|going|in a position|comfortable|possible)|must not|may not)\b)"),
    ("sorry", r"\bsorry,? (?:but )?(?:i|we)(?:'m| am|'re| are)? (?:not |can|un|won)"),
    (" ai|assistant|model", r"\bas an? (?:(?:ai|artificial intelligence|large language|language|virtual|digital)\b[^.!?]{0,30}?(?:model|assistant|system)?|assistant),? (?:i|it|we)\b[^.!?]{0,40}(?:can't|cannot|can not|not|unable|won't|decline)"),
    ("decline|refuse|pass on", r"\b(?:i|we) (?:must|have to|need to|am going to|'m going to|will|would|shall|am obliged to|am forced to|politely|respectfully) (?:politely |respectfully |have to )?(?:decline|refuse|pass on)\b"),
    ("rather not|prefer not", r"\b(?:i|we)(?:'d| would) (?:rather|prefer) not(?: to)?\b"),
    ("can't|cannot|can not|won't|will not|unable|not able|not allowed|not permitted|not wish|n't wish|not want|n't want|refuse|decline", r"\b(?:i|we) (?:can't|cannot|can not|won't|will not|am unable to|'m unable to|am not able to|'m not able to|am not allowed to|'m not allowed to|am not permitted to|do not wish to|don't wish to|do not want to|don't want to|refuse to|decline to) (?:\w+ ){0,2}?(?:help|assist|answer|discuss|share|write|provide|comply|fulfil|fulfill|complete|respond|do|give|support|engage|produce|generate|create|take|continue|talk|comment|reply|offer|solve|explain|disclose|reveal)\b"),
    ("can't|cannot|can not|won't|will not|unable|not able|refuse|decline", r"\b(?:i|we) (?:can't|cannot|can not|won't|will not|shall not|(?:am|'m|are) (?:not able|unable) to|refuse to|decline to) (?:\w+ ){1,2}?(?:anything|something|nothing|any of|this|that|these|it|you|your)\b"),
    ("not have the|n't have the|not feel|n't feel", r"\b(?:i|we) (?:do not|don't) (?:have the (?:ability|permission|authori[sz]ation|means)|feel (?:comfortable|able|at ease))\b"),
    ("guideline|polic|rules|instructions|programming|developer|principles|safety", r"\b(?:my|our|the) (?:guidelines?|polic(?:y|ies)|rules|instructions|programming|developers?|principles|safety \w+) (?:do|does|will|would)?(?: not|n't)? ?(?:not )?(?:let|allow|permit|prevents?|prohibits?|forbids?|stops?)\b"),
    ("would not be |not appropriate|not possible", r"\bwould not be (?:appropriate|right|responsible|ethical|proper|safe) (?:for|of|to)\b|\bit(?:'s| is) not (?:appropriate|possible) for me\b"),
    ("scope|abilit|remit|competence|expertise", r"\b(?:falls?|is|lies?|are) (?:outside|beyond|out of) (?:of )?(?:my|our) (?:scope|abilit\w+|capabilit\w+|remit|competence|expertise)\b"),
    ("be given|be provided|be offered|be shared", r"\bno (?:answer|solution|help|response|assistance|code|comment) (?:can|could|will|shall|may) be (?:given|provided|offered|shared)\b"),
    ("declined|denied|rejected|refused|blocked", r"\brequest\b[^.!?]{0,60}\b(?:declined|denied|rejected|refused|blocked)\b"),
    ("withheld|redacted", r"\b(?:is|are|has been|was|were) (?:withheld|redacted)\b"),
    ("not something", r"\bnot something\b[^.!?]{0,40}\b(?:can|could|will|may|am able to|want to) (?:take on|help|do|assist|discuss|answer|support|provide)\b"),
    ("against|violate|contravene", r"\b(?:against|violates?|contravenes?) (?:my|our|the) (?:\w+ )?(?:guidelines|polic(?:y|ies)|rules|terms)\b"),
    # German
    ("nicht|kein|ablehn|unmöglich|außerstande", r"\b(?:leider|tut mir leid|bedaure|entschuldig\w+|bedauerlicherweise|verzeihung)\b[^.!?]{0,80}\b(?:nicht|kein\w*|ablehnen|unmöglich|außerstande)\b|\bals (?:ki|sprachmodell|assistent|ki-\w+|künstliche intelligenz)\b[^.!?]{0,80}\b(?:nicht|kein\w*)\b"),
    ("nicht|kein|ablehn|unmöglich|außerstande", r"\b(?:ich|wir) (?:muss|müssen|möchte|will|werde|darf|kann|können|dürfen|lehne)\b[^.!?]{0,60}\b(?:ablehnen|ab|verweigern|nicht (?:\w+ )?(?:helfen|beantworten|antworten|bearbeiten|liefern|geben|erfüllen|schreiben|lösen|behandeln|unterstützen|weitergeben|bereitstellen|besprechen|teilen))\b"),
    ("nicht|keine|verweiger|abgelehnt", r"\bkann (?:dazu |hier |dabei |darauf |zu \w+ )?(?:\w+ ){0,5}(?:nicht|keine?) (?:\w+ ){0,3}(?:helfen|beantworten|antworten|weiterhelfen|eingehen|geben|liefern|hilfe)\b|\b(?:nicht erlaubt|nicht gestattet|verweiger\w+|keine antwort geben|abgelehnt)\b"),
    # French
    ("désolé|navré|malheureus|pardon|je regrette|je m'excuse|en tant qu", r"\b(?:désolée?|navrée?|malheureusement|pardon|je regrette|je m'excuse)\b[^.!?]{0,80}\b(?:pas|impossible|refus\w+|incapable)\b|\ben tant qu(?:e |')(?:\w+ ?){0,4}[^.!?]{0,60}\b(?:ne|n')[^.!?]{0,40}\bpas\b"),
    ("je ", r"\bje (?:préfère|dois|souhaite|me vois|suis|vais|refuse|décline)\b[^.!?]{0,40}\b(?:ne pas|refuser|décliner|pas en mesure|incapable|dans l'obligation|de (?:\w+ )?(?:répondre|traiter|fournir|faire))\b"),
    (" pas", r"\bje ne (?:peux|puis|dois|veux|souhaite|suis)\b[^.!?]{0,30}\bpas\b[^.!?]{0,40}\b(?:répondre|aider|fournir|traiter|écrire|donner|partager|faire|autorisée?|en mesure|discuter|résoudre|accéder|satisfaire)\b|\b(?:il ne m'est|m'est) pas (?:permis|possible)\b"),
    # Spanish
    ("lo siento|lament|por desgracia|desafortunad|perdón|perdon|disculp|como ", r"\b(?:lo siento|lamento|lamentablemente|por desgracia|desafortunadamente|perd[oó]n|disculp\w+)\b[^.!?]{0,80}\b(?:no|imposible|rechaz\w+|neg\w+)\b|\bcomo (?:modelo|ia|asistente|inteligencia)\b[^.!?]{0,80}\bno\b"),
    ("rechazar|declinar|negarme|rehusar|no ", r"\b(?:debo|tengo que|prefiero|voy a|me veo)\b[^.!?]{0,30}\b(?:rechazar|declinar|negarme|rehusar|no (?:responder|ayudar|hablar|dar|escribir|resolver|tratar|compartir|ofrecer))\b"),
    ("no puedo|no podemos|no debo|no me|no estoy|me niego|rechazada|denegada", r"\bno (?:puedo|podemos|debo|me es posible|me est[aá] permitido|estoy (?:autorizad[oa]|en condiciones))\b[^.!?]{0,40}\b(?:ayudar\w*|responder\w*|resolver|tratar|escribir|proporcionar|compartir|dar|hacer|atender|ofrecer|contestar|hablar|cumplir|de)\b|\bno me est[aá] permitido\b|\bme niego a\b|\b(?:solicitud|petición)\b[^.!?]{0,40}\b(?:rechazada|denegada)\b"),
    # Italian
    ("mi dispiace|purtroppo|spiacente|scusa|come |non posso|rifiutare|declinare", r"\b(?:mi dispiace|purtroppo|spiacente|scusa)\b[^.!?]{0,80}\b(?:non|impossibile|rifiut\w+)\b|\bcome (?:modello|assistente|ia)\b[^.!?]{0,80}\bnon\b|\bnon posso (?:\w+ ){0,2}(?:aiutar\w*|rispondere|fornire|scrivere|condividere)\b|\bdevo (?:rifiutare|declinare)\b"),
    # Portuguese
    ("desculp|lamento|infelizmente|sinto muito|como |não posso|recusar|declinar", r"\b(?:desculp\w+|lamento|infelizmente|sinto muito)\b[^.!?]{0,80}\b(?:não|impossível|recus\w+)\b|\bcomo (?:modelo|assistente|ia)\b[^.!?]{0,80}\bnão\b|\bnão posso (?:\w+ ){0,2}(?:ajudar|responder|fornecer|escrever|partilhar|compartilhar)\b|\b(?:devo|tenho de|tenho que) (?:recusar|declinar)\b"),
    # Russian
    ("не |невозможно|отказ|вынужден", r"(?:извините|простите|к сожалению|сожалею|прошу прощения|увы)[^.!?]{0,80}(?:не (?:могу|можем|смогу|вправе|имею|получится|буду)|невозможно|отказ|вынужден)|как (?:языковая модель|ии|искусственный интеллект|ассистент|модель|помощник)[^.!?]{0,80}\bне\b"),
    ("не |отказ|отклон|нельзя|запрещ", r"(?:вынужден\w*|должен|должна|приходится|предпочту|предпоч[её]л\w*|придётся|придется)[^.!?]{0,40}(?:отказ\w+|отклонить|не (?:отвечать|помогать|обсуждать|решать|писать|давать))|\bя (?:отказываюсь|не буду|не стану|не могу|не вправе|не имею права|не готов\w*|не в состоянии)[^.!?]{0,40}(?:отвеч\w+|ответ\w+|помо\w+|обсужд\w+|писать|написать|делать|дать|предостав\w+|реш\w+|выполн\w+|работать|рассказ\w+)?|мне (?:нельзя|запрещено|не разрешено|не позволено)|запрос[^.!?]{0,40}отклон[её]н"),
    # Chinese
    ("无法|不能|不可|不便|拒绝|没办法|不会|不愿|不想|谢绝|不允许|不在我的", r"(?:抱歉|对不起|不好意思|很遗憾|遗憾|恕我)[^。！？]{0,40}(?:无法|不能|不可以|不便|拒绝|没办法|不会)|作为(?:一个|一名)?(?:[^。！？，]{0,10})(?:语言模型|人工智能|助手|AI|ai|模型)[^。！？]{0,40}(?:不能|无法|不可|不会|不便)|我(?:不能|无法|不便|不会|拒绝|必须拒绝|只能拒绝|不得不拒绝|不愿|不想)[^。！？]{0,20}(?:回答|提供|帮助|处理|讨论|完成|协助|解决|编写|写|透露|分享|满足|这)|我(?:必须|只能|不得不|选择|需要)拒绝|(?:拒绝|谢绝)(?:回答|提供|处理|完成|这个请求|该请求)|请求[^。！？]{0,12}(?:被拒绝|拒绝)|不允许我|不在我的(?:能力|职责|服务)?范围"),
    # Japanese
    ("ません|かねます|不可能|お答え", r"(?:申し訳|すみません|恐れ入り|残念ながら)[^。！？]{0,40}(?:できません|お答え|いたしかねます|不可能)|(?:お答え|回答|対応|お手伝い)(?:は)?(?:でき|いたし)(?:ません|かねます)"),
)
# For further languages the words of regret, of being unable or unwilling, and of what is asked for.
DECLINING = {
    "Dutch": ("het spijt|sorry|helaas|excuses", "kan niet|kan ik niet|kan je niet|kan u niet|kan daar niet|kan je daar niet|kan u daar niet|mag niet|mag ik niet|zal niet|weiger|niet in staat|niet mogelijk", "help|antwoord|schrijv|gev|lever|voldoen|behandel|bespreken"),
    "Polish": ("przepraszam|przykro mi|niestety|wybacz", "nie mogę|nie możemy|nie jestem w stanie|nie wolno mi|nie będę|odmawiam|muszę odmówić", "pomóc|odpowied|napisać|podać|udziel|spełni|zrobić|omawiać"),
    "Czech": ("omlouvám|bohužel|promiňte|je mi líto", "nemohu|nemůžu|nesmím|odmítám|nejsem schopen|nebudu", "pomoci|odpověd|napsat|poskytnout|splnit|pomoct"),
    "Swedish": ("tyvärr|ursäkta|förlåt|jag beklagar", "kan inte|kan jag inte|får inte|får jag inte|vägrar|kommer inte att|måste avböja", "hjälpa|svara|skriva|ge|lämna|uppfylla"),
    "Danish": ("beklager|desværre|undskyld|dessverre", "kan ikke|kan jeg ikke|må ikke|nægter|vil ikke|må afvise", "hjælpe|hjelpe|svare|skrive|give|gi|levere"),
    "Finnish": ("pahoittelen|valitettavasti|anteeksi", "en voi|en pysty|en saa|kieltäydyn", "auttaa|vastata|kirjoittaa|antaa|toteuttaa"),
    "Hungarian": ("sajnálom|sajnos|elnézést", "nem tudok|nem tudom|nem segíthetek|nem válaszolhatok|visszautasít", "segíteni|válasz|írni|megad"),
    "Romanian": ("îmi pare rău|din păcate|scuze", "nu pot|nu am voie|refuz|nu sunt în măsură", "ajut|răspund|scri|ofer|da "),
    "Turkish": ("üzgünüm|maalesef|özür dilerim|kusura bakma", "yapamam|edemem|veremem|yazamam|yanıtlayamam|cevaplayamam|olamam|olamıyorum|yapamıyorum|reddediyorum|reddetmek|mümkün değil", "yardım|yanıt|cevap|yaz|istek|talep"),
    "Indonesian": ("maaf", "tidak dapat|tidak bisa|tidak boleh|menolak", "membantu|menjawab|menulis|memberikan|memenuhi"),
    "Vietnamese": ("xin lỗi|rất tiếc", "không thể|từ chối|không được phép", "giúp|trả lời|viết|cung cấp|hỗ trợ|thực hiện"),
    "Ukrainian": ("вибачте|перепрошую|на жаль|шкода", "не можу|не маю права|відмовляюся|не буду|змушений", "допомогти|відпов|написати|надати|виконати|обговорювати"),
    "Korean": ("죄송|미안|유감|안타깝", "수 없|못합|못해|불가|거절|거부|않겠", "도와|도움|답변|대답|작성|제공|처리|요청"),
    "Arabic": ("آسف|عذرا|للأسف|أعتذر", "لا أستطيع|لا يمكنني|لا يمكن|أرفض|لن أ", "مساعد|الإجابة|أجيب|كتابة|تقديم|طلب"),
    "Hindi": ("माफ|क्षमा|खेद|दुर्भाग्य", "नहीं कर सकत|नहीं दे सकत|सकता नहीं|नहीं सकत|इनकार|मना कर", "मदद|उत्तर|जवाब|लिख|सहायता|अनुरोध"),
}


def _declining(regret: str, unable: str, asked: str) -> str:
    """Regret and then unable, or unable near what is asked for on either side, within a sentence."""
    within = "[^.!?。！？।]"
    return rf"(?<!\w)(?:{regret}){within}{{0,80}}(?:{unable})|(?:{unable}){within}{{0,60}}(?:{asked})|(?:{asked}){within}{{0,40}}(?:{unable})"


_REFUSAL = [
    (tuple(part for part in parts.split("|") if part), re.compile(re.sub(r"\n\s*", "", phrase), re.IGNORECASE))
    for parts, phrase in (*REFUSALS, *((unable, _declining(regret, unable, asked)) for regret, unable, asked in DECLINING.values()))
]


def declines(text: str) -> bool:
    """Whether a text has a phrase of refusal. A phrase is looked for only where one of its parts is."""
    low = text.lower()
    return any((not parts or any(part in low for part in parts)) and phrase.search(text) for parts, phrase in _REFUSAL)


#: Up to so many words, Chinese and Japanese characters counting as half, a text with a refusal says little else.
#: In a longer one it must stand outside quotes, and at most this share of the sentences may look like an answer.
REFUSAL_WORDS, ANSWER_SHARE = 70, 0.2
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
_NUMBERING = re.compile(r"^\s*(?:\d+[.)]|[-*•])\s*")
_ANSWERING = re.compile(r"[`\d=<>{}\[\]]|\bO\(|\w_\w|\w\(")
_QUOTED = re.compile(r"(?<!\w)'(?:[^'\n]|(?<=\w)'(?=\w))*'(?!\w)|\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|「[^」\n]*」|`[^`\n]*`")

# Frequent function words of the languages in Latin script.
STOPWORDS = {
    "en": "the of and to is that for with it on as are this by be at from or not which when then each every only if we you can its has an was so into than how why what where write explain should must there".split(),
    "de": "der die das und ist nicht den dem des mit für ein eine einen einem auf als auch sich wird man nur wenn dann von zu im zum zur sind durch werden kann daraus damit wie am bei aus oder wie warum was schreibe erkläre lässt gibt falls".split(),
    "fr": "le la les des du et est une un que qui dans pour pas ce cette sur avec au aux par plus ne se on puis si ou son sa ses il elle sont peut d'abord l'entrée enfin où pourquoi comment quand écris explique besoin fonction calcule quel quelle".split(),
    "es": "el la los las del y es una un que en para no por con se su al lo como más este esta cada si primero ya así según entonces también son o está puede sobre cómo qué cuando cuándo escribe explica función calcule necesita solo sólo".split(),
    "it": "il lo gli della dei delle e è una un che di per non con si su al come più questo questa ogni se nel sono anche dal alla può così quindi".split(),
    "pt": "o os das dos e é uma um que em para não por com se ao como mais este esta cada na no são também pode pela pelo ou seu sua então".split(),
    "nl": "de het een en is van niet met voor op te dat die zijn aan als door ook naar bij wordt worden kan maar dan uit deze elke".split(),
}
# Words that hardly ever end a sentence, in several languages; counts may show otherwise.
OPEN_WORDS = frozenset(
    """the a an and or but because than whose nor unless although into our your my its their der den dem ein eine einen einem einer und oder aber weil dass sowie
    le les un une des du et ou mais parce que qui dans avec el los las una y pero porque del al il lo gli della e ma di os as um uma mas do da com
    и или но если что чтобы который в на с к из для""".split()
)
_VOTES: dict[str, list[str]] = {}
for _lang, _words in STOPWORDS.items():
    for _word in _words:
        _VOTES.setdefault(_word, []).append(_lang)

# How an instruction names the language it wants, by language.
WANTED = {
    "en": r"english|englisch|anglais|ingl[eé]s|английск|英语|英文",
    "de": r"german|deutsch|allemand|alem[aá]n|немецк|德语|德文",
    "fr": r"french|französisch|fran[cç]ais|franc[eé]s|французск|法语|法文",
    "es": r"spanish|spanisch|espagnol|español|испанск|西班牙",
    "ru": r"russian|russisch|russe|ruso|русск|俄语|俄文",
    "zh": r"chinese|mandarin|chinesisch|chinois|chino|китайск|中文|汉语|普通话",
    "it": r"italian|italienisch|italien|italiano|итальянск|意大利",
    "pt": r"portuguese|portugiesisch|portugais|portugu[eé]s|португальск|葡萄牙",
    "nl": r"dutch|niederländisch|néerlandais|neerland[eé]s|holland[eé]s|нидерландск|荷兰",
    "ja": r"japanese|japanisch|japonais|japon[eé]s|японск|日语|日文",
    "ko": r"korean|koreanisch|coréen|coreano|корейск|韩语|韩文",
}
#: Letters of scripts that put spaces between words; names in these are whole words, but for an inflection.
_SPACED = r"[0-9_A-Za-zÀ-ɏЀ-ӿ]"
_INFLECTED = rf"(?:e[nmrs]?|as?|s|es|nes?|os|sprachig\w*|[Ѐ-ӿ]+)?(?!{_SPACED})"


def _named(names: str) -> re.Pattern:
    own = [n for n in names.split("|") if n[0] < "⺀"]
    return re.compile("|".join([rf"(?<!{_SPACED})(?:{'|'.join(own)}){_INFLECTED}", *(n for n in names.split("|") if n not in own)]), re.IGNORECASE)


_WANTED = {lang: _named(names) for lang, names in WANTED.items()}
# How a translation is asked for: at the start of a sentence or after a word of request, or into a language.
_TRANSLATION = re.compile(
    r"(?:^|[.!?:;,\n。！？，：]\s*|\b(?:please|you|and|then|now|just|also|bitte|und|dann|por favor|y|et|puis|пожалуйста|и)\s+)"
    r"(?:translate|übersetze?n?|tradui(?:re|s|sez|t)|traduc(?:e|ir|id)|traduzca|traduz(?:ir|a)?|traduc(?:i|ete)|tradurre|переведи(?:те)?|перевести)\b"
    r"|\btranslat(?:e|ion|ed version)\b[^.!?]{0,60}?\b(?:in)?to (?-i:[A-Z])\w+"
    r"|\b(?:переведи(?:те)?|перевод\w*|перевести)\b[^.!?]{0,60}\bна \w+ский\b|翻译(?:成|为|到|一下|以下|下面|下列|这|:|：)|(?:请|把|将|帮我)[^。！？]{0,30}翻译",
    re.IGNORECASE | re.MULTILINE,
)

_FENCE = re.compile(r"^[ \t]*(?:```|~~~).*$", re.MULTILINE)
_TOKEN = re.compile(r"`[^`\n]*`|O\([^()\n]*\)|[㐀-鿿豈-﫿]|[^\W\d_]+(?:['’_-][^\W\d_]+)*|\d(?:[\d.,]*\d)?|[.!?。！？…]+|[^\w\s]")
_ENDERS = frozenset(".!?。！？")
_WORDS = re.compile(r"[㐀-鿿豈-﫿぀-ヿ]|\w+")
_DRESSING = frozenset("question instruction task prompt problem here is the you asked your frage aufgabe pregunta tarea вопрос задача 问题 题目 repeat q a i user request".split())


_UNSEEN = regex.compile(r"(?V1)[\p{Cf}\p{Cc}\p{Cn}\p{Co}--[\n\t\r]]+")
_ENTITY = re.compile(r"&#?\w{1,32};")
_TAG = re.compile(r"</?[A-Za-z][\w-]*\s*/?>")


def is_empty(output: str | None) -> bool:
    """Nothing, nothing visible, fences and tags around nothing, or a placeholder.

    Reads on line by line until there are more words than a placeholder has.
    """
    if output is None:
        return True
    words: list[str] = []
    called = False
    for line in output.split("\n"):
        if "&" in line and _ENTITY.search(line):
            line = html.unescape(line)
        line = _UNSEEN.sub("", line)
        if not line.strip() or _FENCE.match(line):
            continue
        line = _TAG.sub(" ", line)
        called = called or bool(re.search(r"[`=]\w|\w\(", line))
        words += re.findall(r"\w+", line.lower().replace("_", " "))
        if len(words) > 8:
            return False
    return not words or (not called and " ".join(words) in PLACEHOLDERS)


def _split_fences(text: str) -> tuple[str, list[str], bool]:
    """The prose outside fences, the fenced codes, and whether the last fence is open."""
    parts = _FENCE.split(text)
    return "\n".join(parts[0::2]), parts[1::2], len(parts) % 2 == 0


def _parses(text: str) -> bool | int:
    """True, or the line of the first error."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return True
    except SyntaxError as error:
        return -(error.lineno or 1)
    except (ValueError, MemoryError, RecursionError):
        return -1


_CODE_LINE = re.compile(
    r"^\s*(?:def \w|class \w+ ?[(:{]|import [\w.]+(?:,| as |;|\s*$)|from [\w.]+ import|return\b|for .*[:{]\s*$|while .*[:{]\s*$|if .*[:{]\s*$|elif |else:|try:|except\b|with .*:\s*$|@\w|#include"
    r"|(?:public|private|static|using|package|function) [\w.<> ]+[({;=]|(?:int|let|const|var) [\w$\[\]{}, ]+ ?[=;:]|print\(|assert \w+[ (]*[=!<>]|[\w.\[\]]+ ?[-+*/%]?= ?\S|[{}]\s*$)"
)


def looks_like_code(text: str) -> bool:
    lines = [line for line in text.split("\n") if line.strip()]
    return bool(lines) and sum(bool(_CODE_LINE.match(line)) for line in lines) >= 0.4 * len(lines) and not re.match(r"\s*(?:[-*]|\d+\.)\s", lines[0])


def copies_instruction(instruction: str, output: str) -> bool:
    """Whether the output has most of the instruction's words, in its order, and hardly others; once or again and again."""
    asked = _WORDS.findall(unicodedata.normalize("NFKC", instruction).lower())
    given = _WORDS.findall(unicodedata.normalize("NFKC", output).lower())
    if not asked or not given:
        return False
    if len(asked) < 4:
        # Too few to be alike: the same words, alone or several times over.
        said = [w for w in given if w not in _DRESSING] or given
        plain = [w for w in asked if w not in _DRESSING] or asked
        return len(said) % len(plain) == 0 and said == plain * (len(said) // len(plain))
    known = set(asked)
    own = sum(w not in known and w not in _DRESSING for w in given)
    if own > 0.15 * len(given) + 1:
        return False
    left: dict[str, int] = {}
    for word in given:
        left[word] = left.get(word, 0) + 1
    common = 0
    for word in asked:
        if left.get(word, 0) > 0:
            left[word] -= 1
            common += 1
    if common < 0.6 * len(asked):
        return False
    pairs = set(zip(asked, asked[1:]))
    return sum(p in pairs for p in zip(given, given[1:])) >= 0.6 * (len(given) - 1 - own)


def refuses(prose: str) -> bool:
    """Whether a text declines. What stands in quotes isn't said, unless everything does."""
    said = prose.strip().replace("’", "'")
    spoken = _QUOTED.sub(" x ", said)
    if len(_WORDS.findall(spoken)) > 2:
        said = spoken
    if not declines(said):
        return False
    words = _WORDS.findall(said)
    if len(words) - sum(len(w) == 1 and w >= "\u3040" for w in words) / 2 > REFUSAL_WORDS:
        sentences = [s for s in (_NUMBERING.sub("", s) for s in _SENTENCE.split(prose)) if s.strip()]
        return sum(bool(_ANSWERING.search(s)) for s in sentences) <= ANSWER_SHARE * len(sentences)
    return True


_CODE_SPANS = re.compile(r"`[^`]*`|O\([^)]*\)")
_LETTER = re.compile(r"[^\W\d_]")
_SCRIPTS = {name: re.compile(f"[{span}]") for name, span in {"han": "一-鿿㐀-䶿", "kana": "぀-ヿ", "cyrillic": "Ѐ-ӿ", "hangul": "가-힯"}.items()}
_LATIN_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def language(text: str, evidence: float = 2.5) -> str | None:
    """The human language of a text, None where there is too little to tell."""
    plain = _CODE_SPANS.sub(" ", text)
    if not plain.isascii():
        letters = len(_LETTER.findall(plain))
        if not letters:
            return None
        han, kana, cyrillic, hangul = (len(s.findall(plain)) for s in _SCRIPTS.values())
        if han + kana >= 0.15 * letters and han + kana >= 4:
            return "ja" if kana > 0.2 * (han + kana) else "zh"
        if hangul >= 0.3 * letters:
            return "ko"
        if cyrillic >= 0.3 * letters and cyrillic >= 6:
            return "ru"
    votes: dict[str, float] = {}
    words = _LATIN_WORD.findall(plain.lower())
    for word, n in Counter(filter(_VOTES.__contains__, words)).items():
        for lang in _VOTES[word]:
            votes[lang] = votes.get(lang, 0) + n / len(_VOTES[word])
    if "'" in plain or "’" in plain:
        elided = sum(len(word) > 2 and word[1] in "'’" and word[0] in "ldnsjcmt" for word in words)
        if elided:
            votes["fr"] = votes.get("fr", 0) + 0.7 * elided
    if not votes:
        return None
    ranked = sorted(votes.items(), key=lambda x: -x[1])
    best = ranked[0]
    second = ranked[1][1] if len(ranked) > 1 else 0
    return best[0] if best[1] >= evidence and best[1] >= 1.6 * second else None


def wrong_language(instruction: str, prose: str) -> bool:
    answer = language(prose)
    if answer is None:
        return False
    asked = language(instruction, 1.0)
    if asked is None or asked == answer:
        return False
    wanted = _WANTED.get(answer)
    return not ((wanted and wanted.search(instruction)) or _TRANSLATION.search(instruction))


# Endings


def _normal(token: str) -> str:
    first = token[0]
    if first == "`":
        return "`"
    if first.isdigit():
        return "0"
    if first == "O" and token[1:2] == "(":
        return "O()"
    return token


def _last_line(prose: str) -> str:
    return prose.rstrip().rsplit("\n", 1)[-1]


_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_INT = [int(k) for k in _K]
_MASK = (1 << 64) - 1


def _mix(x: int) -> int:
    """mix64 of one number."""
    x &= _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def _contexts(a, b, c, k=_K, mix=mix64) -> list:
    """The keys of a word c after a and b: all three, the last two, the outer two, the word alone."""
    with np.errstate(over="ignore"):
        return [mix(mix(a * k[0] + b) * k[1] + c), mix(b * k[2] + c), mix(mix(a * k[3] + c) + k[1]), mix(c * k[0] + k[3])]


class Codes(dict):
    """A token's hash: numbers, code and names inside a sentence count as one token each."""

    def __missing__(self, token: str) -> int:
        if len(self) >= TOKEN_CACHE:
            self.clear()
        plain = _normal(token)
        value = self[token] = xxhash.xxh64_intdigest(plain.lower())
        return value


_NAME = xxhash.xxh64_intdigest("n")


def _is_word(token: str) -> bool:
    return token.isalpha() and token[0] < "\u2e80"


def _prefix_key(prefix: str) -> int:
    return _mix(xxhash.xxh64_intdigest(prefix) ^ _INT[4])


def _after_key(before: int, key: int) -> int:
    return _mix(before * _INT[2] + key)


def _read(line: str, codes: Codes):
    """(token, a, b, c, following token) of every word of a line; a and b are the codes of the words before it in its sentence."""
    tokens = _TOKEN.findall(line)
    a = b = 0
    opening = True
    for k, token in enumerate(tokens):
        first = token[0]
        if first in _ENDERS:
            opening, a, b = True, 0, 0
        elif first.isalnum() or first == "`":
            c = _NAME if not opening and first.isupper() and token[:2] != "O(" else codes[token]
            yield token, a, b, c, tokens[k + 1] if k + 1 < len(tokens) else None
            a, b, opening = b, c, False


def question(line: str, codes: Codes) -> tuple[list[int], float] | None:
    """The keys by which an ending without full stop is judged, and how often its last word is taken to end a sentence before anything is counted.

    The keys are those of its four contexts, of its last word as a beginning, and of that after the word before; None if it has no words.
    """
    last = None
    for last in _read(line, codes):
        pass
    if last is None:
        return None
    token, a, b, c, _ = last
    keys = _contexts(a, b, c, _INT, _mix)
    if _is_word(token):
        begun = _prefix_key(token.lower())
        keys += [begun, _after_key(b, begun)]
    return keys, 0.0 if token.lower() in OPEN_WORDS else UNSEEN


def verdict(counts: list[tuple[int, int]], prior: float) -> bool:
    """Whether an ending is complete, by (seen, ends) of its keys."""
    (seen3, ends3), (seen2, ends2), (seen_, ends_), (seen1, ends1) = counts[:4]
    if len(counts) > 4:
        begun, after = counts[4][0], counts[5][0]
        if (begun >= BEGUN and seen1 < ITSELF * begun) or (after >= BEGUN_AFTER and seen2 < ITSELF * after):
            return False  # the beginning of a frequent word, hardly ever a word
    lean = lambda ends, seen, p: (ends + LEAN * p) / (seen + LEAN)
    alone = lean(ends1, seen1, prior)
    return lean(ends3, seen3, max(lean(ends2, seen2, alone), lean(ends_, seen_, alone))) >= END_SHARE


def count_keys(texts, codes: Codes, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, seen, ends) of the contexts and beginnings in some texts; with the array ``asked``, of those it has."""
    a, b, c, end, words = [], [], [], [], {}
    for prose in texts:
        for line in prose.split("\n"):
            for token, x, y, z, following in _read(line, codes):
                if following is not None:
                    a.append(x)
                    b.append(y)
                    c.append(z)
                    end.append(following[0] in _ENDERS)
                if _is_word(token):
                    pair = (y, token)
                    words[pair] = words.get(pair, 0) + 1
    keys, seen, ends = [], [], []

    def add(some: np.ndarray, n: np.ndarray, e: np.ndarray) -> None:
        if asked is not None:
            kept = asked[(some >> np.uint64(64 - ASKED_BITS)).astype(np.int64)]
            some, n, e = some[kept], n[kept], e[kept]
        keys.append(some)
        seen.append(n)
        ends.append(e)

    if c:
        ending, one = np.array(end, np.int64), np.ones(len(c), np.int64)
        for some in _contexts(*(np.array(x, np.uint64) for x in (a, b, c))):
            add(some, one, ending)
    begun: dict[str, list[int]] = {}
    first, before, times = [], [], []
    for (y, token), n in words.items():
        own = begun.get(token)
        if own is None:
            low = token.lower()
            own = [_prefix_key(low[:k]) for k in range(1, len(low))]
            if asked is not None:
                own = [x for x in own if asked[x >> (64 - ASKED_BITS)]]
            begun[token] = own
        for x in own:
            first.append(x)
            before.append(y)
            times.append(n)
    if first:
        prefix, times = np.array(first, np.uint64), np.array(times, np.int64)
        with np.errstate(over="ignore"):
            after = mix64(np.array(before, np.uint64) * _K[2] + prefix)
        for some in (prefix, after):
            add(some, times, np.zeros(len(times), np.int64))
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    keys, seen, ends = (np.concatenate(x) for x in (keys, seen, ends))
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, seen, len(keys)).astype(np.int64), np.bincount(at, ends, len(keys)).astype(np.int64)


class Endings:
    """Which words end sentences, counted over texts at hand."""

    def __init__(self):
        self.codes, self.counts = Codes(), {}

    def learn(self, texts) -> None:
        for key, seen, ends in zip(*(x.tolist() for x in count_keys(texts, self.codes))):
            s, e = self.counts.get(key, (0, 0))
            self.counts[key] = (s + seen, e + ends)

    def complete(self, line: str) -> bool:
        """Whether a line without a sentence end may be one; what is unknown counts as complete."""
        asked = question(line, self.codes)
        return asked is None or verdict([self.counts.get(k, (0, 0)) for k in asked[0]], asked[1])


_HANGING = re.compile(r"(?:[,;:(\[{\\/&+=<«„—–-]|\.\.\.|…)\Z")
_SEQUENCE = re.compile(r"(?:-?\d[\d.]*|\w)(?:\s*[,;]\s*(?:-?\d[\d.]*|\w)){2,}\s*[,;]?\s*(?:\.\.\.|…)\Z")


_SENTENCE_END = re.compile(r"[.!?](?=\s)|[。！？]")


def broken_ending(output: str, kind: str | None, fenced: list[str], open_fence: bool) -> bool | str:
    """Whether an output breaks off; the last line, where that is for the counts of endings to say."""
    if open_fence:
        return True
    if not fenced and looks_like_code(output):
        return code_breaks_off(output)
    tail = _FENCE.split(output)[-1] if fenced else output
    tail = tail.rstrip()
    while tail and (unicodedata.category(tail[-1]) in ("So", "Cf", "Mn") or tail[-1].isspace()):
        tail = tail[:-1]
    if not tail.strip():
        return bool(fenced) and code_breaks_off(fenced[-1], fenced=True)
    block = re.split(r"\n[ \t]*\n", tail)[-1]
    if block != tail and looks_like_code(block):
        return code_breaks_off(block, fenced=True)
    line = _last_line(tail).strip()
    if re.match(r">>> |\.\.\. |\$ ", line) or (tail.count("\n") and re.search(r"^>>> ", tail, re.MULTILINE)):
        return False
    if _SEQUENCE.search(line):
        return False
    if _HANGING.search(line):
        return True
    closed = re.sub(r"(?<=[.!?。！？])\s*\([^()]*\)\Z", "", line).rstrip("\"'”’»*_)]")
    if closed and (closed[-1] in _ENDERS):
        return False
    last = _SENTENCE_END.split(line)[-1]
    if last.count("`") % 2:
        return True
    if last.count("(") > last.count(")") and not re.search(r"[:;]-?\(", last):
        return True
    if len(_WORDS.findall(re.sub(r"`[^`]*`|O\([^()]*\)", "x", tail))) < 4:
        return False
    return line


def code_breaks_off(code: str, fenced: bool = False) -> bool:
    """Whether source ends before it is complete; errors elsewhere are none of this."""
    stripped = code.rstrip()
    if not fenced and code.endswith("\n") and not stripped.endswith(":"):
        return False
    verdict = _parses(code)
    if verdict is True:
        return False
    last = stripped.count("\n") + 1
    lexed = scan_python(code)
    if lexed in (PREMATURE, UNTERMINATED) and (fenced or not code.endswith("\n")):
        return True
    if stripped.endswith(":") and -verdict >= last:
        return True
    if not fenced and code.endswith("\n"):
        return False
    if -verdict >= last:
        return True
    # Not Python: more brackets opened than closed at the end.
    opened = sum(code.count(c) for c in "([{") - sum(code.count(c) for c in ")]}")
    return opened > 0 and not fenced


def rules(instruction: str | None, output: str | None, kind: str | None) -> tuple[list[str], str | None]:
    """The defects of a pair in the order of DEFECTS, and the ending that counts must judge, if any."""
    if is_empty(output):
        return ["empty"], None
    instruction = instruction or ""
    prose, fenced, open_fence = _split_fences(output)
    code = not fenced and looks_like_code(output)
    found = []
    if copies_instruction(instruction, output):
        found.append("copied_question")
    if not code and refuses(prose):
        found.append("refusal")
    if not code and wrong_language(instruction, prose):
        found.append("wrong_language")
    ending = broken_ending(output, kind, fenced, open_fence)
    if ending is True:
        found.append("truncated")
    return found, ending if isinstance(ending, str) else None


def defects_of(instruction: str | None, output: str | None, kind: str | None, endings: Endings | None) -> list[str]:
    """Every defect of a pair, in the order of DEFECTS."""
    found, ending = rules(instruction, output, kind)
    if ending is not None and endings is not None and not endings.complete(ending):
        found.append("truncated")
    return found


# Spark


def _judge(batches):
    codes = Codes()
    for batch in sliced(batches):
        found, keys, priors = [], [], []
        for i, o, k in zip(*(batch.column(c).to_pylist() for c in ("instruction", "output", "kind"))):
            defects, ending = rules(i, o, k)
            asked = question(ending, codes) if ending is not None else None
            found.append(defects)
            keys.append(None if asked is None else np.array(asked[0], np.uint64).view(np.int64))
            priors.append(None if asked is None else asked[1])
        some = pa.array([bool(f) or k is not None for f, k in zip(found, keys)])
        arrays = [batch.column("idx"), pa.array(found, pa.list_(pa.string())), pa.array(keys, pa.list_(pa.int64())), pa.array(priors, pa.float64())]
        yield pa.RecordBatch.from_arrays([x.filter(some) for x in arrays], names=["idx", "defects", "keys", "prior"])


def _slots(batches):
    """The numbers of the slots that a task's keys set; the array has a fixed size, so they are at most that many."""
    asked = np.zeros(1 << ASKED_BITS, bool)
    for batch in batches:
        keys = batch.column("key").to_numpy().view(np.uint64)
        asked[(keys >> np.uint64(64 - ASKED_BITS)).astype(np.int64)] = True
    packed = np.packbits(asked)
    for block, part in enumerate(np.split(packed, 1 << (ASKED_BITS - 19))):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "bits"])


def _either(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, bits in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist()):
            part = np.frombuffer(bits, np.uint8)
            total[block] = total[block] | part if block in total else part
    for block, bits in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["block", "bits"])


def _asked(keys: DataFrame) -> np.ndarray:
    """Which slots some key is in: 2**ASKED_BITS bits, whatever the number of keys."""
    schema = "block int, bits binary"
    packed = np.zeros(1 << (ASKED_BITS - 3), np.uint8)
    for row in keys.mapInArrow(_slots, schema).repartition(16, "block").mapInArrow(_either, schema).toLocalIterator():
        packed[row["block"] << 16 : (row["block"] + 1) << 16] = np.frombuffer(row["bits"], np.uint8)
    return packed


def _count(packed):
    def run(batches):
        codes, asked = Codes(), np.unpackbits(packed.value).view(bool)
        for batch in sliced(batches):
            outputs = batch.column("output").to_pylist()
            keys, seen, ends = count_keys((_split_fences(o)[0] for o in outputs if o and not looks_like_code(o)), codes, asked)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(seen), pa.array(ends)], names=["key", "seen", "ends"])

    return run


def defective_pairs(pairs: DataFrame) -> DataFrame:
    """(idx, defects): the defective rows with every defect that a rule found, in order.

    A null output is empty, a null instruction is an empty text that nothing can copy. Rows with a
    null idx are left out; repeated rows are judged each.
    """
    context = pairs.sparkSession.sparkContext
    judged = materialise(
        pairs.where("idx is not null").select("idx", "instruction", "output", "kind")
        .mapInArrow(_judge, "idx long, defects array<string>, keys array<long>, prior double")
        .withColumn("row", F.monotonically_increasing_id())
    )
    asks = judged.where("keys is not null").select("row", F.posexplode("keys").alias("at", "key"))
    packed = context.broadcast(_asked(asks.select("key")))
    counts = (
        pairs.where("output is not null").select("output").mapInArrow(_count(packed), "key long, seen long, ends long")
        .groupBy("key").agg(F.sum("seen").alias("seen"), F.sum("ends").alias("ends"))
    )
    answers = (
        spread_join(asks, counts, "key", how="left")
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("seen", F.lit(0)).alias("seen"), F.coalesce("ends", F.lit(0)).alias("ends")))).alias("n"))
    )
    return (
        judged.join(answers, "row", "left")
        .select("idx", F.when(~_complete(F.col("n"), F.col("prior")), F.array_append("defects", F.lit("truncated"))).otherwise(F.col("defects")).alias("defects"))
        .where(F.size("defects") > 0)
    )


def _complete(n: F.Column, prior: F.Column) -> F.Column:
    """``verdict`` as a column."""
    seen, ends = (lambda i: F.get(n, F.lit(i))["seen"]), (lambda i: F.get(n, F.lit(i))["ends"])
    begins = F.coalesce(((seen(4) >= BEGUN) & (seen(3) < ITSELF * seen(4))) | ((seen(5) >= BEGUN_AFTER) & (seen(1) < ITSELF * seen(5))), F.lit(False))
    lean = lambda i, p: (ends(i) + LEAN * p) / (seen(i) + LEAN)
    alone = lean(3, prior)
    return ~begins & (lean(0, F.greatest(lean(1, alone), lean(2, alone))) >= END_SHARE)


def defects_found(pairs: DataFrame) -> DataFrame:
    return defective_pairs(pairs).select("idx", F.col("defects")[0].alias("defect")).distinct()


def defect_report(pairs: DataFrame) -> DataFrame:
    """(source, kind, defect, n_rows) of the defective rows, by every defect found."""
    found = defective_pairs(pairs).select("idx", F.explode("defects").alias("defect"))
    return pairs.select("idx", "source", "kind").join(found, "idx").groupBy("source", "kind", "defect").agg(F.countDistinct("idx").alias("n_rows"))
