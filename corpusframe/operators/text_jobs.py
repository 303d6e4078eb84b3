"""Table jobs over texts: tokens, profiles, languages, blocked words, key sentences, follow-up queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusframe.functions import text as T

#: Frequent words of languages in Latin script, accents folded; ties go to the first listed.
FREQUENT_WORDS = {
    "en": "the and is of to that it for you are was with this be have what how hello thank",
    "fr": "le les des est et une du que qui pas pour dans ce il elle nous vous je au avec sont bonjour merci",
    "es": "el los las que y en una es por con para del se lo como pero hola gracias muy",
    "pt": "os as que e do da em um uma nao para com por mais dos das ola obrigado voce",
    "de": "der die das und ist nicht ein eine ich zu den mit von sie es auf fur dem hallo danke",
    "it": "il di che e un una per non con del della sono gli ciao grazie",
    "nl": "het een en is van dat niet op ik je te zijn voor hallo dank",
    "id": "yang dan di ini itu dengan untuk tidak ada dari saya akan ke terima kasih",
    "tr": "bir ve bu da icin ile cok degil merhaba tesekkur",
    "pl": "nie i w na z sie to ze jest do jak dzien dobry",
    "vi": "cua nhung duoc trong khong nguoi va la cac mot nay cho xin chao toi ban cam hoc sinh truong giao vien",
}
#: Letters that are worth two words.
TELLING_LETTERS = (("[ñ¿¡]", "es"), ("ß", "de"), ("[ãõ]", "pt"), ("[ğşı]", "tr"), ("[łąęśźżń]", "pl"))
#: Scripts, tried in this order (code point ranges).
SCRIPTS = (
    ("[ᄀ-ᇿ㄰-㆏가-힣]", "ko"), ("[぀-ヿㇰ-ㇿｦ-ﾟ]", "ja"), ("[一-鿿㐀-䶿]", "zh-CN"),
    ("[฀-๿]", "th"), ("[຀-໿]", "lo"), ("[ក-៿]", "km"), ("[က-႟]", "my"), ("[Ⴀ-ჿ]", "ka"), ("[԰-֏]", "hy"),
    ("[Ͱ-Ͽ]", "el"), ("[֐-׿]", "he"), ("[ሀ-፿]", "am"), ("[ঀ-৿]", "bn"), ("[਀-੿]", "pa"), ("[઀-૿]", "gu"),
    ("[଀-୿]", "or"), ("[஀-௿]", "ta"), ("[ఀ-౿]", "te"), ("[ಀ-೿]", "kn"), ("[ഀ-ൿ]", "ml"), ("[඀-෿]", "si"),
    ("[ހ-޿]", "dv"), ("[ऀ-ॿ]", "hi"),
    ("[іїєґІЇЄҐ]", "uk"), ("[ђјљњћџЂЈЉЊЋЏ]", "sr"), ("[әғқңөұһӘҒҚҢӨҰҺ]", "kk"), ("[Ѐ-ӿ]", "ru"),
    ("[ٹڈڑںے]", "ur"), ("[پچژگ]", "fa"), ("[؀-ۿ]", "ar"),
    ("(?iu)[đăơưảạằắẳẵặầấẩẫậẻẽẹềếểễệỉĩịỏọồốổỗộờớởỡợủũụừứửữựỳỷỹỵ]", "vi"),
)


def detect_language(text: str = "text") -> Column:
    """The script decides where it can; else the language most of whose frequent words occur. No word, or a tie with English, is English.

    Scripts have no letter below U+0100 and telling letters none below U+0080, so both are looked for among a text's other letters
    alone; words are cut once, and the lists meet only those that stand in some list."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(t)
    odd = F.regexp_replace(low, r"[\x00-\x7F]+", "")

    def telling(letters: Column) -> Column:
        return F.array(*[F.when(letters.rlike(own), 2).otherwise(0) for own, _ in TELLING_LETTERS])

    every = F.lit(sorted({w for own in FREQUENT_WORDS.values() for w in own.split()}))
    words = F.array_intersect(F.regexp_extract_all(F.when(odd == "", low).otherwise(T.fold_accents(low)), F.lit("[a-z]+"), F.lit(0)), every)
    extra = {lang: i for i, (_, lang) in enumerate(TELLING_LETTERS)}

    def vote(known: Column) -> Column:
        more = lambda lang: known["extra"][extra[lang]] if lang in extra else F.lit(0)
        scores = F.array(*[F.size(F.array_intersect(known["words"], F.lit(own.split()))) + more(lang) for lang, own in FREQUENT_WORDS.items()])
        best = lambda s: F.array_position(s, F.array_max(s)).cast("int")  # noqa: E731  (the first of the highest)
        return F.transform(F.array(scores), lambda s: F.when(F.array_max(s) == s[0], "en").otherwise(F.element_at(F.lit(list(FREQUENT_WORDS)), best(s))))[0]

    def script(letters: Column) -> Column:
        out = F.when(letters == "", None)
        for pattern, lang in SCRIPTS:
            out = out.when(letters.rlike(pattern), lang)
        return out

    # what a lambda is given is looked at once, however often it stands inside
    own = F.transform(F.array(F.regexp_replace(t, r"[\x00-\xFF]+", "")), script)[0]
    voted = F.transform(F.array(F.struct(words.alias("words"), F.transform(F.array(odd), telling)[0].alias("extra"))), vote)[0]
    return F.coalesce(own, voted)


def tokenize_documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Postings (key, term, tf) of T4 tokens."""
    return docs.select(key, F.explode(T.tokens_expanded(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def profile_text(docs: DataFrame, by: str = "source", text: str = "text") -> DataFrame:
    """Texts, letters and texts changed by OCR cleaning, per group, language and accent loss."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(by, detect_language(text).alias("language"), T.lost_accents(text).alias("lost"), F.char_length(t).alias("chars"), (T.clean_ocr(text) != t).alias("dirty"))
    return rows.groupBy(by, "language", "lost").agg(F.count("*").alias("texts"), F.sum("chars").alias("chars"), F.count_if("dirty").alias("dirty"))


def thin_texts(pages: DataFrame, doc: str, page: str, text: str, least: int = 80) -> DataFrame:
    """Documents with fewer than so many characters a page."""
    each = pages.groupBy(doc).agg(F.sum(F.char_length(F.trim(F.coalesce(text, F.lit(""))))).alias("chars"), F.count_distinct(page).alias("pages"))
    return each.withColumn("thin", F.col("chars") < least * F.col("pages"))


def _alternation(terms: Sequence[str]) -> str:
    import re

    return "|".join(r"\s+".join(re.escape(w) for w in t.split()) for t in sorted(terms, key=lambda t: (-len(t), t)))


def _hits(texts: str, pattern: Column) -> Column:
    return F.transform(texts, lambda v: F.regexp_extract_all(v, pattern, F.lit(1)))


def flag_blocked(messages: DataFrame, terms: Mapping[str, Sequence[str]], bare_terms: Mapping[str, Sequence[str]] = {}, allowed: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Messages with groups (in the order given) and matched terms; allowed phrases are taken out first.

    Terms of terms are compared with the evasion variants as they are, those of bare_terms with accented words masked. Term
    lists are parameters; a row meets one expression per group and variant.
    """
    variants = T.evasion_variants(text)
    if allowed:
        out = rf"(?<!\S)({_alternation(allowed)})(?!\S)"
        variants = F.transform(variants, lambda v: F.regexp_replace(v, out, " "))
    rows = messages.withColumn("__v", variants).withColumn("__m", F.transform("__v", T.masked_accents))
    groups = list(dict.fromkeys([*terms, *bare_terms]))
    per_group = []
    for g in groups:
        found = []
        for own, where in ((terms.get(g, ()), "__v"), (bare_terms.get(g, ()), "__m")):
            if own:
                pattern = F.lit(rf"(?<!\S)({_alternation(own)})(?!\S)")
                found.append(F.flatten(_hits(where, pattern)))
        per_group.append(F.array_distinct(F.concat(*found)))
    rows = rows.withColumn("__f", F.array(*per_group))
    names = F.lit(groups)
    hit = F.filter(F.transform("__f", lambda f, i: F.when(F.size(f) > 0, names[i])), lambda g: g.isNotNull())
    return rows.withColumns({"groups": hit, "matched": F.array_distinct(F.flatten("__f"))}).drop("__v", "__m", "__f")


def preview_term(messages: DataFrame, term: str, terms: Mapping[str, Sequence[str]], order: str, last: int, examples: int = 5, text: str = "text") -> DataFrame:
    """Of the last messages those that only the new term would block: their number and a few of them, newest first."""
    recent = messages.orderBy(F.desc(order)).limit(last)
    both = flag_blocked(flag_blocked(recent, terms, text=text).withColumnRenamed("groups", "__old").drop("matched"), {"new": [term]}, text=text)
    new = both.where((F.size("__old") == 0) & (F.size("groups") > 0))
    return new.agg(F.count("*").alias("blocked"), F.slice(F.transform(F.sort_array(F.collect_list(F.struct(order, text)), asc=False), lambda s: s[text]), 1, examples).alias("examples"))


def key_sentences(passages: DataFrame, question: str = "question", text: str = "text", key: Sequence[str] = ("query_id", "passage_id")) -> DataFrame:
    """Of each passage the sentence nearest its question: two per shared word pair, one per shared word, three at least.

    A sentence under 80 characters takes the next one along; 500 characters at most. Ties go to the first sentence.
    """
    rows = passages.select(*key, T.tokens(question).alias("q"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"(?<=[.!?;])\s+|\n+")).alias("pos", "sentence")).where("trim(sentence) <> ''")
    rows = rows.withColumn("t", T.tokens("sentence")).withColumn("next", F.lead("sentence").over(W.partitionBy(*key).orderBy("pos")))
    pairs = lambda t: F.array_distinct(F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))
    rows = rows.withColumn("score", 2 * F.size(F.array_intersect(pairs(F.col("q")), pairs(F.col("t")))) + F.size(F.array_intersect("q", "t")))
    said = F.when((F.char_length("sentence") < 80) & F.col("next").isNotNull(), F.concat_ws(" ", "sentence", "next")).otherwise(F.col("sentence"))
    best = rows.where("score >= 3").groupBy(*key).agg(F.max_by(F.struct("score", F.substring(said, 1, 500).alias("sentence")), F.struct("score", -F.col("pos"))).alias("b"))
    return best.select(*key, "b.score", "b.sentence")


def followup_queries(turns: DataFrame, markers: Sequence[str], most_tokens: int = 12, back: int = 6, user: str = "user") -> DataFrame:
    """User turns of turns(conv_id, turn, role, text) with query: the last user text among the six messages before is put
    in front when the question has at most so many words or a marker word."""
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-back, -1)
    rows = turns.withColumn("previous", F.last(F.when(F.col("role") == user, F.col("text")), ignorenulls=True).over(before)).where(F.col("role") == user)
    words = T.raw_tokens("text")
    follows = F.col("previous").isNotNull() & ((F.size(words) <= most_tokens) | F.arrays_overlap(words, F.lit(list(markers))))
    return rows.select("conv_id", "turn", follows.alias("follows"), F.when(follows, F.concat_ws(" ", "previous", "text")).otherwise(F.col("text")).alias("query"))
