"""Language of a text by scripts and frequent words, and codes of language names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frequent words of each language.
WORDS = {
    "en": "the and of to in that was he his with had for not is as it be you but on her at from this they were which she have would their",
    "fr": "le la les des et un une du de dans que qui pour pas est il elle avec sur au aux ne son sa ses mais par se ce cette était avait",
    "de": "der die das und ist war nicht ein eine den dem des mit sich von zu auf sie er es als auch wie aber nach noch aus bei wir",
    "es": "el la los las del que en y un una por con para no se su sus al lo como más pero era había este esta sin sobre",
    "it": "il lo la gli le di che e un una in non per con del della si era nel nella ma come più suo sua sono questo questa",
    "pt": "o a os as que de do da dos das em um uma não com para por se ao sua seu como mas mais era tinha foi pelo pela",
    "nl": "de het een en van dat die hij zij zijn haar niet met op te voor aan als maar om door ook was er deze uit naar ik",
    "sv": "och det att en ett som på av den till är var med för han hon inte om sig men jag så hade från skulle mig detta",
    "da": "og det at en et som på af den til er var med for han hun ikke om sig men jeg så havde fra skulle mig dette",
    "no": "og det at en et som på av den til er var med for han hun ikke om seg men jeg så hadde fra skulle meg dette",
    "fi": "ja on oli että hän se ei mutta kun niin kuin hänen jotka tämä sen myös mitä olla sitten ovat vain kanssa minä tai jos vielä",
    "pl": "i w z na się nie do że to a jest jego jak ale za od po o go tak przez dla już był była jej który co",
    "cs": "a v na se že to je s do z jak ale jeho byl byla pro jako tak za od co i jsou při nebo když jsem",
    "hu": "a az és hogy nem egy is volt meg de el ha mint ezt azt már van csak még én ő aki úgy vagy minden után",
    "ro": "și de în la cu un o nu pe este din că care se mai pentru lui să ce dar era ea el au fost când",
    "tr": "bir ve bu da de için ile o ne gibi çok daha ama olan kadar sonra ben sen onu her değil var mi ki olarak",
    "la": "et in est non ad cum ut qui quae quod sed ex eius esse sunt nec per autem ab quam enim atque quo erat ac hoc",
    "eo": "la kaj de en al ne li ŝi ĝi estas estis ke kiu kun por sur sed kiel ili mi vi tiu per pri el aŭ ankaŭ",
    "ru": "и в не на что он с как его я но она это по из к у за от все так был было для то же они мы",
    "uk": "і в не на що він з як його я але вона це по із до у за від все так був було для та вони ми",
    "bg": "и в не на че той с как неговата аз но тя това по от към за беше бяха като да се те сме при още",
}
#: Scripts that name a language, and the least letters of a text.
SCRIPTS = {"Greek": "el", "Hangul": "ko", "Hebrew": "he", "Han": "zh"}
KANA = "[[\\p{IsHiragana}\\p{IsKatakana}]&&\\p{L}]"
#: Ranges that hold every letter of those scripts, and none of Latin; looked for first, as a range is quicker than a script.
BEYOND_LATIN = "[\\x{0370}-\\x{1DFF}\\x{1F00}-\\x{1FFF}\\x{2126}\\x{2E80}-\\x{10FFFF}]"
MIN_LETTERS, LONG, SKIP = 80, 12000, 4000


def sample(text: Column) -> Column:
    """What is read of a text: all, or in a long one what follows its opening."""
    return F.when(F.length(text) > LONG, F.substring(text, SKIP + 1, 2**31 - 1)).otherwise(F.coalesce(text, F.lit("")))


def script(text: Column) -> Column:
    """The language that a text's script names, or null; a text without such a script is only searched for one."""
    letters = F.regexp_count(text, F.lit("\\p{L}"))
    kana = F.regexp_count(text, F.lit(KANA))
    out = F.when((kana >= 20) & (kana > letters * 0.05), F.lit("ja"))
    for name, code in SCRIPTS.items():
        out = out.when(F.regexp_count(text, F.lit(f"[\\p{{Is{name}}}&&\\p{{L}}]")) > letters * 0.6, F.lit(code))
    return F.when(text.rlike(BEYOND_LATIN), out)


#: Words whose bits one long holds, and bits of a count, of which a long holds two.
BITS, COUNT_BITS = 62, 31


def word_table(spark: SparkSession, words: dict[str, str] = WORDS) -> DataFrame:
    """A row for each word of the lists: word, n0, n1, ... (a one in the field of each language that lists it, two fields a long), m0, m1, ... (the word's own bit)."""
    codes, all_words = sorted(words), sorted({w for ws in words.values() for w in ws.split()})
    lists = {c: set(ws.split()) for c, ws in words.items()}
    rows = []
    for k, w in enumerate(all_words):
        fields = [int(w in lists[c]) for c in codes] + [0]
        rows.append((w, *(fields[j] + (fields[j + 1] << COUNT_BITS) for j in range(0, len(codes), 2)), *(1 << (k % BITS) if k // BITS == m else 0 for m in range(-(-len(all_words) // BITS)))))
    names = [f"n{j}" for j in range(-(-len(codes) // 2))] + [f"m{m}" for m in range(-(-len(all_words) // BITS))]
    return spark.createDataFrame(rows, "word string, " + ", ".join(f"{n} long" for n in names))


def detect(docs: DataFrame, key: str, text: str = "text", words: dict[str, str] = WORDS) -> DataFrame:
    """``key`` and detected of each row of docs: the language code, or null where the text does not show one.

    A text is split into words once, and each word looked up once in a broadcast table of all lists (a few hundred
    rows).  The counts are sums that a task ends for its own texts, so a row of numbers for each text is all that is
    shuffled.  Null and empty texts give null; rows that repeat a key are told apart.
    """
    codes, all_words = sorted(words), sorted({w for ws in words.values() for w in ws.split()})
    place = {w: k for k, w in enumerate(all_words)}
    table = word_table(docs.sparkSession, words)
    s = docs.select(F.monotonically_increasing_id().alias("id_"), F.col(key).alias("key_"), sample(F.col(text)).alias("s_"))
    s = s.withColumn("script_", script(F.col("s_"))).withColumn("found_", F.regexp_extract_all(F.lower("s_"), F.lit("\\p{L}+"), F.lit(0)))
    each = s.select("id_", "key_", "script_", F.explode_outer("found_").alias("word")).join(F.broadcast(table), "word", "left")
    counts = [(F.sum if c[0] == "n" else F.bit_or)(c).alias(c) for c in table.columns[1:]]
    counted = each.groupBy("id_", "key_", "script_").agg(F.count("word").alias("total"), F.sum(F.length("word")).alias("letters"), *counts)
    counted = counted.fillna(0, ["letters", *table.columns[1:]])

    def score(k: int) -> Column:
        packed = F.col(f"n{k // 2}")
        return F.shiftright(packed, COUNT_BITS) if k % 2 else packed.bitwiseAND(F.lit((1 << COUNT_BITS) - 1))

    def distinct(code: str) -> Column:
        masks: dict[int, int] = {}
        for w in set(words[code].split()):
            masks[place[w] // BITS] = masks.get(place[w] // BITS, 0) | 1 << (place[w] % BITS)
        out = F.lit(0)
        for m, mask in sorted(masks.items()):
            out = out + F.bit_count(F.col(f"m{m}").bitwiseAND(F.lit(mask)))
        return out

    langs = F.sort_array(F.array(*(F.struct(score(k).alias("score"), distinct(c).alias("distinct"), F.lit(c).alias("code")) for k, c in enumerate(codes))), asc=False)
    best, second = F.col("langs")[0], F.coalesce(F.get("langs", F.lit(1))["score"], F.lit(0))
    clear = (best["distinct"] >= 5) & (best["score"] >= 10) & (best["score"] >= F.col("total") * 0.05) & (best["score"] > second * 1.2)
    detected = F.when(F.col("letters") < MIN_LETTERS, F.lit(None).cast("string")).when(F.col("script_").isNotNull(), F.col("script_")).when(clear, best["code"])
    return counted.withColumn("langs", langs).select(F.col("key_").alias(key), detected.alias("detected"))


def language_codes(spark: SparkSession) -> DataFrame:
    """name, code of every language that the JVM knows: two- and three-letter codes, and English, French and own names."""
    locale = spark._jvm.java.util.Locale
    names = {"francais": "fr"}
    for code in locale.getISOLanguages():
        own = locale.forLanguageTag(code)
        names.setdefault(code, code)
        names.setdefault(own.getISO3Language(), code)
        for shown in (locale.ENGLISH, locale.FRENCH, own):
            names.setdefault(own.getDisplayLanguage(shown).lower(), code)
    return spark.createDataFrame(sorted(names.items()), "name string, code string")


def with_code(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """df with language_code: of the language named in ``column``, null if unknown."""
    c = F.broadcast(codes.withColumnRenamed("code", "language_code"))  # a few hundred rows
    return df.join(c, F.lower(F.trim(F.col(column))) == c["name"], "left").drop("name")
