"""Timed tables derived from the test tables, so that queries and their SQL read the same input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Events of one item.
EVENTS_AN_ITEM = 1250


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cue every three seconds for each turn of a conversation."""
    start = F.lit(600.0) + F.lit(3.0) * F.col("turn")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("track_id"), F.col("turn").cast("int").alias("cue_idx"), start.alias("start_s"), (start + 1.5).alias("end_s"), "text")


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of 0.8 to 4 seconds, events spread over 72 minutes an item."""
    events = table(spark, sf_dir, "events").where("ts is not null")
    items = max(1, events.count() // EVENTS_AN_ITEM)
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / F.lit(600e6)
    value = F.coalesce("value", F.lit(0.0))
    rows = events.select((F.col("user_id") % items).alias("item_id"), "event_id", start.alias("start_s"), value.alias("value"))
    return rows.select("item_id", "event_id", "start_s", (F.col("start_s") + 0.8 + (F.col("value") - F.floor("value")) * 3.2).alias("end_s"))


def film_cues(spans: DataFrame, offset: float, scale: float) -> DataFrame:
    """Cues of the spans: a twentieth dropped, each earlier and longer than what is said, moved by offset and scale."""
    kept = spans.where(F.col("event_id") % 20 != 0)
    lead, hold = 0.05 + (F.col("event_id") % 26) / 100.0, 0.1 + (F.col("event_id") % 51) / 100.0
    return kept.select("item_id", "event_id", (offset + scale * (F.col("start_s") - lead)).alias("start_s"), (offset + scale * (F.col("end_s") + hold)).alias("end_s"))


# cases of anchor points: (case_id, offset, scale, points)
CASES = [(0, 0.1, 1.0, 6), (1, 1.4, 1.0, 6), (2, 0.0, 0.95904, 6), (3, 6.0, 25 / 24, 6), (4, -2.0, 1.0005, 6), (5, 0.2, 1.0, 1), (6, 3.0, 1.0, 2), (7, 0.0, 1.00005, 6)]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor points of each case, every ten minutes; every fourth nation's are scattered, and weak in case 4."""
    cases = spark.createDataFrame(CASES, "case_id int, off double, scale double, n int")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k"))
    rows = nations.crossJoin(F.broadcast(cases)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = 600.0 * (F.col("i") + 1)
    wild = F.when(F.col("k") % 4 == 3, ((F.col("i") * 7 + F.col("k")) % 5) * 2.5).otherwise(0.0)
    sure = F.when((F.col("case_id") == 4) & (F.col("i") % 2 == 0), 0.1).otherwise(0.8)
    return rows.select((F.col("k") * 100 + F.col("case_id")).alias("case_key"), at.alias("at_s"), (F.col("off") + F.col("k") / 1000.0 + (F.col("scale") - 1.0) * at + wild).alias("offset_s"), sure.alias("confidence"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported tracks: one a document, four an item."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    verdict = F.element_at(F.array(*[F.lit(v) for v in ("InSync", "Offset", "Drifting", "Mismatched", "Unknown", "InSync")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return docs.select(
        F.floor(F.col("doc_id") / 4).alias("item_id"), (F.col("doc_id") % 4).cast("int").alias("track_idx"), F.col("lang").alias("language"), verdict.alias("verdict"),
        (F.col("n_chars") % 900).cast("int").alias("cue_count"), (F.col("doc_id") % 7 == 0).alias("hearing_impaired"), (F.col("doc_id") % 3 == 1).alias("external"),
        F.when(F.coalesce("quality", F.lit(1)) == 0, "not read").alias("skipped"), F.col("source"), F.coalesce("toxic", F.lit(0)).alias("toxic"),
    )


# paragraphs in the languages that are told apart: (number, what they are tagged as, text); every seventh has another tag
_SAID = [
    ("en", "The man that you saw was not here for long, but what have you done with this box and the key?"),
    ("es", "No es la casa de la señora, está en el pueblo por una razón que no conoce para ir con ella."),
    ("pt", "Você não está com uma ideia de tudo isso, mas ele vai por aqui para ver a canção que é dela."),
    ("fr", "Vous pour les gens qui est dans une ville avec elle, des jours que je ne vois pas."),
    ("it", "Questo non è come una cosa della quale sono sicuro, anche per te che vieni con più amici."),
    ("de", "Ich und der Mann mit dem Hut, wir sind nicht auf der Straße, sie ist ein Teil und die das weiß."),
    ("nl", "Het is niet wat een van ons voor ogen had, maar dat heb ik met hem naar huis gebracht, zijn ze."),
    ("sv", "Jag har det inte här, men vi som bor för långt bort och vet att han kom med tåget."),
    ("da", "Jeg har ikke været til det, men hvad kan hun og han gøre med båden, den var væk fra øen."),
    ("no", "Jeg har ikke vært til det, men hva kan hun og han gjøre med hytta, den var borte og øde."),
    ("fi", "Hän ei ole täällä kun olen kotona, mutta se on niin että sinä ja minä tiedämme tämä on totta."),
    ("pl", "Nie wiem czy tak jest, ale bardzo się cieszę jak tylko przez to wszystko i tego chciałem, łąka."),
    ("cs", "Ale jsem tady, protože když jsi byl doma, tak co bylo všechno jenom sen, jak řekl můj přítel."),
    ("sk", "Ale ja som tam bol, keď ako vždy prečo nie, všetko je iba sen a tu musíme byť veľmi ticho."),
    ("ro", "Este ceva bine pentru care nu sunt acum din oraș, dar cu mama așa mergem în țară."),
    ("hu", "Nem kell még egy, csak ez volt már meg, hogy van idő, mit mondott az őr a tűzről."),
    ("tr", "Bu çok iyi bir şey değil ama için için ne var gibi daha güzel olarak ağaç büyük."),
    ("el", "Δεν είναι για να που θα και με από στο αλλά μου είπε κάτι ωραίο το πρωί."),
    ("ru", "Мы не знаем что это, но они так хотят как все, если меня и тебя объявить, ты это видишь."),
    ("uk", "Ми не знаємо що це, але вони так хочуть як все, якщо мене і тебе їхній друг бачить."),
    ("bg", "Той не знае защо да се върне, но аз ще бъда тук като това на масата, както и как е."),
    ("id", "Saya tidak tahu yang ini untuk kamu, dan kita sudah bisa pergi dengan itu ke pasar."),
    ("vi", "Tôi không biết một người của chúng ta, những điều này được anh cho đã lâu rồi ở nơi đó."),
    ("ca", "Això que els amics fan amb una casa és molt aquest any, però aquí no hi ha res per a tots."),
    ("ko", "우리는 오늘 아침에 시장에 가서 사과와 빵을 사고 집으로 돌아왔습니다"),
    ("ja", "私たちは今朝市場へ行ってりんごとパンを買い家に帰りました"),
    ("zh", "我们今天早上去市场买了苹果和面包然后就回家了大家都很高兴"),
    ("th", "เช้านี้เราไปตลาดเพื่อซื้อแอปเปิ้ลและขนมปังแล้วกลับบ้าน"),
    ("ar", "ذهبنا هذا الصباح إلى السوق لشراء التفاح والخبز ثم عدنا إلى البيت"),
    ("he", "הבוקר הלכנו לשוק לקנות תפוחים ולחם ואז חזרנו הביתה"),
    ("hi", "आज सुबह हम सेब और रोटी खरीदने बाज़ार गए और फिर घर लौट आए"),
]
PARAGRAPHS = [(k, "en" if k % 7 == 0 else lang, " ".join([said] * 4)) for k, (lang, said) in enumerate(_SAID, 1)]


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents (doc_id, text, lang), and the paragraphs under negative numbers."""
    own = spark.createDataFrame([(-k, t, lang) for k, lang, t in PARAGRAPHS], "doc_id long, text string, lang string")
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang").unionByName(own)
