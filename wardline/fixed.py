"""What the engine's results are defined by. Word lists that a deployment brings itself are parameters instead."""

# Folding of look-alikes for words: every character on the left counts as the letter on the right.
FOLD = {
    "a": "аa@4àáâãäåя", "b": "бb6", "v": "вv", "g": "гgґ", "d": "дd", "e": "еёэe3éèêë", "j": "ж", "z": "зz2",
    "i": "ийыi1!|íìîïyý", "k": "кk", "l": "лlł", "m": "мm", "n": "нnñ", "o": "оo0óòôõö", "p": "пpр", "r": "r",
    "s": "сs5$śš", "c": "cçцч", "t": "тt7ť", "u": "уuúùûüю", "f": "фf", "h": "хxh×", "w": "шщw",
}
# Characters that count for nothing inside a word.
IGNORED = "\u200b\u200c\u200d\u2060\ufeff\u00ad\u180e" + "ъь'`´\"′"
LEET = "013457@$*!"
SOFT_SIGNS = "ьъЬЪ"

# Folding of look-alikes for domains; another alphabet than the one for words.
DOMAIN_FOLD = dict(zip("ᴍᴄʀᴇᴀʟʏᴡᴏᴜᴅɴᴛꜱɪʙɢʜᴋᴘꜰᴠᴢ", "mcrealywoudntsibghkpfvz", strict=True))
DOMAIN_FOLD |= dict(zip("саеорхукмтнвгдлпфий", "caeopxykmthvgdlnfii", strict=True))
DOMAIN_FOLD |= {"э": "e", "ю": "u", "я": "ya", "ь": "", "ъ": "", "ё": "e"}
DOMAIN_FOLD |= {chr(ord("ａ") + i): chr(ord("a") + i) for i in range(26)}
TLD_ALIASES = {"phun": "fun", "funn": "fun", "fuun": "fun", "t0p": "top", "pr0": "pro", "c0m": "com", "n3t": "net", "0rg": "org", "orgg": "org"}

FUNCTION_WORDS = frozenset(
    "у в на за по до от из с к о об под над при про для без через между перед после около среди вокруг "
    "и а но да нет не ну же ли бы то так как что это вот там тут здесь уже еще ещё только даже тоже "
    "если чтобы когда где куда или либо ведь разве неужели "
    "я ты он она оно мы вы они мне тебе ему ей нам вам им меня тебя его ее её нас вас их кто чей "
    "весь все вся себя свой мой твой наш ваш".split()
)
SAFE_WORDS = tuple(
    "хуже худая худой худощавый худенький художник художественный похвала похвалить похвальный похоже похожий похожесть похлебка "
    "похолодание похороны членство членение членистоногие членовредительство анализ аналитика аналитик аналог аналогичный analysis "
    "analyst analytics classic classes cocktail scunthorpe assassin assessment bass compass passion сукно суконный трахея трактат "
    "трактовка задний идиома лохматый дебет уродливый фрикаделька мудрость мудрый употреблять употребление хелпер помощь помощник "
    "поддержка bypass bypassed hello shell button grape therapy document documents".split()
)
BLOCKED_WORDS = ("нурик", "нурсултан", "арбузклиент", "кфг", "xray", "искрей", "импакт", "бустит", "дельта")
COMMANDS = ("broadcast", "bc", "say", "msg", "tell", "m", "whisper", "r", "reply", "me", "em", "ad", "message")
CAPS_WHITELIST = ("ЛОЛ", "ГГ", "АФК")

TLDS = tuple(
    "ru com net org io me gg tv cc us su py pf uk de fr jp cn co info biz xyz online shop site tech store app blog dev live cloud wiki "
    "news media fun club vip bet stream chat email life company systems solutions community academy center group tools today best win "
    "digital agency page art team top pro space website host icu games world link click".split()
)
SPACED_TLD_STOP = frozenset(
    "me us gg tv co cc io art team best today news win life live chat app media page group tools vip bet wiki top pro space world link "
    "click games host website".split()
)
QUICK_TRIGGERS = ("http", "https", "www", "bitly", "clck", "discord", "telegram", "youtube", "youtu", "twitch", "дискорд", "телеграм")

# Patterns, in the dialect of java.util.regex; the spans module says how Python reads them.
LINK = r"(?i)(?:https?://)?[\w\p{L}\-]+(?:\.[\w\p{L}\-]+){1,}"
LINK_FALLBACK = r"(?i)[\w\p{L}\-]+(?:\.[\w\p{L}\-]+){1,}"
IP = r"(?i)\b\d{1,3}(?:\s*[\.\,\-․·]\s*\d{1,3}){3}(?:\s*:\s*\d{2,5})?\b"
DISCORD = r"(?i)(?:https?://)?(?:www\.|ptb\.|canary\.)?(?:discord(?:app)?\.(?:com|gg)/(?:invite|servers?)/?|discord\.gg/)[a-z0-9-_]{2,32}"
DOT_WORD = r"(?:\s*[\.\,․·/;]\s*|\s+(?:dot|точка|тчк)\s+)"
OBFUSCATED_DOMAIN = (
    r"(?i)\b[\w\p{L}][\w\p{L}\-]{0,62}" + DOT_WORD + r"[\w\p{L}][\w\p{L}\-]{0,48}" + DOT_WORD + r"[\w\p{L}]{2,24}\b"
    r"|\b[\w\p{L}][\w\p{L}\-]{1,62}" + DOT_WORD + r"[\w\p{L}]{2,12}\b"
)
INVITE = (
    r"(?i)\b(?:t\.me|telegram\.me|tg:\/\/join|vk\.com|vk\.cc|bit\.ly|goo\.gl|tinyurl\.com|youtu\.be)\/[\w\-]{3,64}\b"
    r"|\b(?:dsc\.gg|invite\.gg)\/[\w\-]{2,32}\b"
)
INVISIBLE = r"[\u200B\u200C\u200D\u2060\uFEFF\u00A0\u1680\u180E\u2000-\u200F\u2028\u2029\u202F\u205F\u3000]+"
SCHEME = r"(?i)^\s*h\s*t\s*t\s*p\s*s?\s*:\s*/\s*/\s*"
OBFUSCATED_DOT = r"(?i)\[dot\]|\(dot\)|\{dot\}|\.dot\.|\s+dot\s+|\s*(?:точка|тчк|т\.ч\.к\.|с\s+точкой|с\s+тчк)\s*"
HANDLE_STRICT = r"(?:^|[^\p{L}\p{N}_])@([\p{L}\p{N}_](?:[\p{L}\p{N}_.\-]{2,40})[\p{L}\p{N}_])"
HANDLE_LOOSE = r"@([\p{L}\p{N}_.\-]{3,48})"
URLISH = r"(?i)(?:https?://|www\.|t\.me/|discord\.gg/|vk\.com/|dsc\.gg/)"
MENTION = r"@([A-Za-z0-9_]{2,16})(?![A-Za-z0-9_])"
TARGET_TOKEN = r"[\p{L}\p{N}_@][\p{L}\p{N}_@.-]{0,62}"
TARGET_DOMAIN = r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}-]{0,62}(?:\s*[.․·]\s*[\p{L}\p{N}][\p{L}\p{N}-]{0,62}){1,5}(?![\p{L}\p{N}])"

PROMO_KEYWORDS = (
    "тгк", "tgk", "тг", "tg", "телега", "телеграм", "телеграмм", "telegram", "дс", "дискорд", "discord", "dsc", "подпишись", "подписка",
    "ссылка", "ссылку", "переходи", "лучший тгк", "мой тгк", "наш тгк", "тг канал", "тг-канал", "invite", "инвайт", "промокод",
    "реклама", "айпи", "donate",
)
# Taken where a deployment's own list is empty: one keyword and one template more than above and below.
DEFAULT_KEYWORDS = (*PROMO_KEYWORDS, "донат")
WEAK_KEYWORDS = frozenset(("ip", "сервер", "канал", "ds", "dsc", "tg", "tgk", "заходи"))
TEMPLATES = (
    "самый лучший тгк {name}", "самый топовый тгк {name}", "лучший тгк {name}", "топовый тгк {name}", "мой тгк {name}", "наш тгк {name}",
    "тг канал {name}", "тг-канал {name}", "телеграм канал {name}", "телега {name}", "подпишись на тгк {name}", "заходи в тгк {name}",
    "переходи в тгк {name}", "ссылка на тгк {name}", "скидываю тгк {name}", "в тгк {name}", "самый лучший tgc {name}",
    "лучший tgc {name}", "топовый tgc {name}", "самый лучший tgk {name}", "лучший tgk {name}", "топовый tgk {name}",
    "telegram {@name}", "discord {@name}", "дискорд {@name}", "дс {@name}", "наш дискорд {@name}", "наш дс {@name}",
    "заходи в дискорд {@name}", "заходи в дс {@name}", "discord сервер {@name}", "дискорд сервер {@name}", "invite {@name}",
    "инвайт {@name}", "топовый гриферский сервер {domain}", "лучший гриферский сервер {domain}", "гриферский сервер {domain}",
    "топовый анархо сервер {domain}", "лучший анархия сервер {domain}", "анархо сервер {domain}", "анархия сервер {domain}",
    "ванильный сервер {domain}", "выживание сервер {domain}", "топовый сервер {domain}", "новый сервер {domain}",
    "открылся сервер {domain}", "заходи на сервер {domain}", "залетайте на сервер {domain}", "играй на сервере {domain}",
    "ip сервера {domain}", "айпи сервера {domain}", "ip {domain}", "айпи {domain}", "наш сервер {domain}", "лучший сервер {domain}",
    "заходи на {domain}",
)
DEFAULT_TEMPLATES = (*TEMPLATES[:23], "tg {@name}", *TEMPLATES[23:])
TARGET_TLDS = frozenset(
    "ru su com net org io me gg fun top pro space site online xyz club shop store host icu games world link click info biz cc tv us uk "
    "de app live tech".split()
)
# Only entries that a folded Latin name can equal.
TARGET_STOP = frozenset("tgk tgc tg telegram discord dsc invite donate mini games mc ip the best server".split())
FILLER_ANCHORS = frozenset(
    "sami samii lucwi lucwii lucsi luci topovi topovii moi nas eto kak dla ili ocen prosto ochen i na v po za ot do iz so the and best top "
    "ms mc".split()
)
CRITICAL = ("tgk", "tgc", "telegram", "telega", "telegpam", "telegpamm", "discord", "dsc", "invite", "invait", "sepvep", "tg", "ip", "ds", "aipi")
SHORT_ANCHORS = frozenset(("tg", "ip", "ds"))
PLATFORM_PARTS = ("discord", "дискорд", "telegram", "телеграм", "телега", "телеграмм", "тгк", "tgc", "tgk")
PLATFORM_WORDS = ("tg", "ds", "dsc", "тг", "дс")
PLATFORM_KEYS = frozenset((*PLATFORM_PARTS, *PLATFORM_WORDS))
RECRUITING = (
    "лучший", "топовый", "самый", "подпишись", "подписка", "подписывайтесь", "заходи", "заходите", "залетайте", "переходи", "переходите",
    "ссылка", "ссылку", "тгк", "tgc", "tgk", "тг канал", "тг-канал", "телеграм канал", "наш тгк", "наш tgc", "наш дискорд", "наш дс",
    "наш сервер", "discord сервер", "дискорд сервер", "invite", "инвайт", "промокод", "реклама", "сервер", "айпи", "грифер", "анарх",
    "ванильн", "выживани",
)
RECRUITING_FOLDED = (
    "lucw", "topov", "podpis", "zahodi", "perehod", "ssilka", "tgk", "tgc", "sepvep", "invait", "invite", "reklama", "promokod", "aipi",
    "gifer", "anarho", "anarhia",
)

# Colours of the codes 0 to f, and the codes that are no colours.
PALETTE = tuple("000000 0000aa 00aa00 00aaaa aa0000 aa00aa ffaa00 aaaaaa 555555 5555ff 55ff55 55ffff ff5555 ff55ff ffff55 ffffff".split())
STYLE_CODES = "klmnor"
# Verbs of actions, by whom they reach.
ACTIONS = {
    "player": ("message", "sound", "title", "subtitle", "actionbar", "player-command", "effect", "teleport", "give-item"),
    "console": ("message-console", "console-command"),
    "all": ("broadcast",),
}
