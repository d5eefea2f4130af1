"""Small tables of articles with every awkward case."""

SCHEMA = "URL string, `要約` string, `配信元` string, id long, text string, recipe string, component_id string"


def articles(spark, rows):
    """Rows of (URL, text, source) with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(u, t, s, 7, "other", "r", "c") for u, t, s in rows], SCHEMA)


LONG = " ".join(f"wort{i % 977} und{i % 89}" for i in range(40_000))
AWKWARD = [
    ("https://a.example/1", "One two three four five six seven.", "alpha"),
    ("https://a.example/2", "One two  three four\nfive six seven.", "alpha"),
    ("https://a.example/3", "One two three four five six seven.", None),
    ("https://a.example/3", "One two three four five six seven.", None),  # a repeated row
    ("https://a.example/4", None, "beta"),
    ("https://a.example/5", "", "beta"),
    ("https://a.example/6", " \t\r\n\x0b\x0c", None),
    (None, "Nobody knows where this one came from.", "gamma"),
    (None, None, None),
    ("https://a.example/7", LONG, "beta"),
    ("https://a.example/8", LONG + " ende", "beta"),
    ("https://a.example/9", "é漢字🙂 <|endoftext|> don't STOP", "gamma"),
]


def collected(df):
    return [r.asDict() for r in df.collect()]
