"""Word lists that results depend on, kept as they are."""

COLLECTION_KEYWORDS = [
    "сборник", "антология", "коллекция", "компиляция", "собрание сочинений", "сборник сочинений", "избранное", "избранные произведения", "лучшее", "лучшие",
    "шедевры", "шедевры фантастики", "хиты", "популярные", "роман-эпопея", "топ", "классика", "легендарные", "великие", "полное собрание", "собрание произведений",
    "собрание сочинений", "полное собрание сочинений", "произведения", "труды", "best of", "highlights", "essentials", "complete works", "compilation", "anthology",
]
SERVICE_WORDS = [
    "том", "volume", "vol", "т.", "v.", "часть", "part", "п.", "pt.", "выпуск", "issue", "вып.", "книга", "book", "кн.", "сборник", "collection", "серия", "трилогия", "trilogy",
    "дилогия", "дилогии", "duology", "тетралогия", "tetralogy", "пенталогия", "pentalogy", "гексалогия", "hexalogy", "гепталогия", "окталогия", "ноналогия", "декалогия", "цикл",
]
NAME_PARTICLES = ["де", "ди", "дю", "ду", "да", "дер", "ден", "дель", "дела", "делла", "дэлла", "дос", "дас", "дэ", "ван", "фон", "ля", "ле", "ла", "мак", "о"]
SURNAME_CONVERSIONS = {
    "Гоблин (MeXXanik)": "Гоблин MeXXanik", "Айзенберг": "Берг", "Старец": "Старицын", "Роберт Дж. Сойер": "Роберт Сойер", "Лейкин Марк": "Мах Макс", "Кондакова Анна": "Райро А.",
    "Шмаев Валерий": "Сержант Леший", "Гоблин, Каин": "Гоблин MeXXanik", "Романович Роман": "Романович (Пастырь) Роман", "Горъ (Гозалишвили) Василий": "Горъ Василий", "Юнас": "Йонас",
    "Юань Е": "Юань Е", "Бэн": "Бен", "Бирюк": "Бирюк Валерий", "Shellina": "Шеллина Олеся", "Постельгио": "Постегильо",
}
NO_SERIES_FOLDERS = [
    "вне серий", "вне серии", "без серии", "без серий", "несерийное", "несерийный", "внесерийное", "отдельные произведения", "отдельное произведение", "standalone",
    "вне цикла", "вне циклов", "без цикла",
]
SERIES_CLEANUP_PATTERNS = [
    r"\s*\(АСТ\)\s*", r"\s*\(Издательство АСТ\)\s*", r"\s*\(Эксмо\)\s*", r"\s*\(соавтор[ы]?[^)]*\)\s*", r"\s*\(автор[ы]?[^)]*\)\s*",
    r"\s*\(с участием[^)]*\)\s*", r"\s*\(co-?author[s]?[^)]*\)\s*", r"\s*\(with [^)]*\)\s*", r"\s*\(by [^)]*\)\s*",
]
SERIES_SIZES = ["", "Дилогия", "Трилогия", "Тетралогия", "Пенталогия", "Гексалогия", "Гепталогия", "Окталогия", "Ноналогия", "Декалогия"]
UNKNOWN_AUTHOR, NO_TITLE, ANTHOLOGY, COAUTHORS = "[unknown]", "[no title]", "Сборник", "Соавторство"
FILENAME_BLACKLIST = [
    "компиляция", "+", "Артефакт - детектив", "МИФ Проза", "Азбука-бестселлер", "Книга-загадка, книга-бестселлер", "Книга-загадка", "The Big Book",
    "О. Р. З. или Сказ о том, как Михалыч пить бросал", "Loft. Автофикшн", "Loft", "Tok", "Звезда соцсети", "Fantasy World", "Fanzon", "Neoclassic", "downloads", "collection",
    "издат", "космическая фантастика", "скачанные", "обложка", "компиляции", "изд", "антология", "загрузки", "temp", "various", "коллекция", "авторский", "лучшее", "разные",
    "серия", "tmp", "download", "(АСТ)", "военная фантастика", "боевая фантастика", "фантастика", "romance", "любовный", "детектив", "mystery", "БФ", "попаданец",
    "фантастический боевик", "современный фантастический боевик", "библиотека победы", "Сборник сочинений", "собрание сочинений", "сборник", "шедевры фантастики", "ЛенИздат",
    "библиотека", "СИ", "Эксмо", "Короли французского триллера", "1918 год", "Acting president", "Центрполиграф", "О. Р. З.", "Ка",
]
VARIANT_KEYWORDS = [
    "вариант", "альтернативный", "альтернативная", "альтернативное", "версия", "ЛП", "СИ", "самиздат", "черновик", "черновая", "редакция", "alt", "alternate", "alternative", "draft",
    "fan translation", "фанперевод",
]
EXTENSION_FOLDERS = ["fb2", "rtf", "pdf", "doc", "docx", "txt", "epub", "djvu", "djv", "mobi", "azw", "azw3", "lit", "lrf", "html", "htm", "odt", "zip", "rar", "7z"]
#: Words for a compilation, and of how many volumes; the first one found counts.
COMPILATION_WORDS = {
    "дилогия": 2, "трилогия": 3, "тетралогия": 4, "пенталогия": 5, "гексалогия": 6, "гепталогия": 7, "окталогия": 8, "ноналогия": 9, "декалогия": 10,
    "дилог": 2, "трилог": 3, "тетралог": 4, "пенталог": 5, "гексалог": 6, "гепталог": 7, "omnibus": None, "omnib": None, "trilogy": 3, "tetralogy": 4, "сборник": None,
}
TITLE_WORDS = {
    "битва", "война", "король", "королевство", "императорь", "империя", "мир", "мира", "небесный", "звезда", "звезд", "звёзд", "звёзда", "край", "земля", "земли", "ночь", "день",
    "огонь", "вода", "молния", "гром", "шторм", "ураган", "зима", "лето", "весна", "осень", "город", "замок", "дворец", "храм", "церковь", "святилище", "квест", "поиск", "охота",
    "охотник", "путешествие", "путь", "магия", "магический", "чарованный", "чародей", "волшебник", "герой", "герои", "боец", "боцена", "воїн",
}
BLOCK_QUALIFIERS = {"весь", "вся", "все", "полный", "полная", "полное", "целый", "целая", "целое", "complete", "omnibus"}
FILE_PATTERNS = [
    "Title (Author)", "Title - (Author)", "Title - Title (Author)", "Author - Title", "(Author) - Title", "Title - Author", "Author - Title (Series)",
    "Author - Title (Series) Text", "Author - Title (Series. service_words)", "Author - Series. Title (Series service_words)",
    "Author - service_words. Series. Title (Series service_words)", "Author - Title (Series. service_words) text", "Author - Title (Series. service_words) - text",
    "Author - Title (Series) (text)", "Author - Title (Series. SubSeries. SubSubSeries)", "Author, Author - Title (Series)", "Author, Author - Title (Series. service_words)",
    "Author. Title", "Author. Title (Series. service_words)", "Author. Title (Series. Title. service_words)", "Author. service_words «Series»",
    "Author. service_words «Series». Text", "Author. service_words «Series» text. Title", "Author, Author. Title (Series)", "Author, Author. Title (Series service_words)",
    "Author, Author. Title (Series. Title. service_words)", "Author. Series (service_words)", "Author. Series. service_words", "Author. Series. Title",
    "Author. Series. SubSeries. service_words. Title", "Author. Series. SubSeries. Title", "Author - Series. Title", "Author - Series (service_words)",
    "Author - Series. SubSeries (service_words)", "Author - Series. SubSeries. Title", "Author - Series. SubSeries. service_words. Title",
    "Author, Author - Series service_words. SubSeries.  Title",
]
NAME_SUFFIXES = ["мл", "ст", "младший", "старший", "ср", "средний", "вл", "владелец"]
#: Endings of two letters that surnames have, and endings of whole surnames for a late swap.
SURNAME_ENDINGS = ["ов", "ев", "ин", "ын", "ан", "ян", "ер", "ор", "ич", "иц", "ей", "ко", "ли", "ло", "ды", "ца"]
INNER_SURNAME_ENDINGS = ["ов", "ев", "ин", "ын", "ан", "ян", "ер", "ор", "ич", "иц"]
SWAPPED_SURNAME_ENDINGS = ["ов", "ев", "ич", "ович", "ский", "цкий", "ова", "ева", "ина", "янь", "ень", "ань", "ш"]
SHARED_SURNAME_ENDINGS = ["ские", "ский", "ского", "скому", "ским", "ске", "ская", "скую", "ской", "ое", "ого", "ому", "ым", "ом", "ий"]
NON_AUTHOR_WORDS = [
    "трилогия", "дилогия", "пенталогия", "тетралогия", "сборник", "авторский", "авторская", "авторское", "цикл", "цикла", "циклов",
    "серия", "серии", "сборка", "компиляция", "сборки", "книг", "книга", "книги", "издание", "издания", "переиздание",
]
FOLDER_CATEGORY_STARTS = ["Unknown", "Various"]
SPECIAL_SERIES = ["Шерлок Холмс. Свободные продолжения"]
AWARD_WORDS = ["премия", "award", "prize", "лауреат", "номинант"]
COLLECTIVE_NAMES = ["коллектив авторов", "collective authors", "various authors"]
#: What ends the levels of a series in brackets.
LEVEL_ENDS = ["дилогия", "трилогия", "тетралогия", "пентагония", "внецикл", "дополнение", "прелюдия", "эпилог"]
