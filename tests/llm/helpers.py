"""Small tables with everything that can go wrong in them."""

import random

DDL = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, ids binary, component_id long, label string, n_words long, spans string"
EXTRA = (0.5, True, b"x", 7, "y", 3, "z")
LONG = " ".join(f"word{i % 977}" for i in range(60_000))


def frame(spark, rows):
    """(doc_id, text, lang) rows with further columns whose names clash with results."""
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), *EXTRA) for i, t, lang in rows], DDL)


def tricky(spark):
    """Nulls anywhere, empty and blank and very long texts, repeated rows, ties."""
    return frame(spark, [(1, None, "en"), (2, "", None), (3, " \n\t ", "en"), (4, LONG, "en"), (5, "same text as the next one here", "en"), (5, "same text as the next one here", "en"), (6, "same text as the next one here", "en"), (None, "a row without an id but some text", "en"), (7, "é ü 漢字 😀 <|endoftext|>\r\n tab\tx   three  ", "de")])


def empty(spark):
    return frame(spark, [])


def prose(rng: random.Random, words: int, stem: str = "") -> str:
    syllables = ["an", "er", "th", "ing", "ou", "st", "re", "on", "ti", "ha"]
    return " ".join(stem + "".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(words))


def shuffled_bytes(spark, run) -> int:
    """Bytes that the stages of ``run`` wrote for shuffles."""

    def so_far():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}

    before = so_far()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(v for k, v in so_far().items() if k not in before)
