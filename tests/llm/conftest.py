import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, text_key string, print long, words int"
LONG = 9000


def row(doc_id, text, lang=None):
    return (doc_id, text, lang, None, None, "x", "y", 1, 2)


@pytest.fixture(scope="session")
def texts():
    random.seed(3)
    vocabulary = ["the", "of", "Straße", "don't", "été", "一二三", "x1", "mit", "license", "A", " ", "it's", "b-c", "gnu"]
    long = " ".join(random.choice(vocabulary) for _ in range(LONG))
    run = "a" * 5000
    near = [f"w{i}" for i in range(400)]
    cards = "card 4111 1111 1111 1111, +44 20 7946 0958; 10.0.0.1 me.x@mail.example.org 4111111111111112 300.1.1.1"
    return [
        None,
        "",
        " ",
        "\n\t \r\n",
        "one",
        "one two",
        "?!",
        "12345",
        long,
        long,
        run + " b  \n c " + run,
        " \n" * 3000 + "end",
        cards,
        "x" + "\U0001f600" * 3 + " " + cards + " " + cards,
        "a@b.com_x@d.e @@ a@b a@b..c . 1.2.3.4.5.6.7.8 +1((((( +12 +1 2-3.4(5)67890",
        "Licensed under the MIT License. mit license gnu general public license apache license cc by mit mit license",
        "Permission is hereby granted, free of any charge, to any person obtaining a copy and more",
        "IBAN DE89 3704 0044 0532 0130 00 and ssn 123-45-6789 or 123-45-6789" + " " * 80 + "then 321-54-9876",
        " ".join(near),
        " ".join(near[:200] + ["changed"] + near[201:]),
        " ".join(near),
        "'re 's don'T we'll  x  y",
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [row(n, t, ("en", "fr")[n % 2]) for n, t in enumerate(texts)]
    rows += [row(4, "one", "en"), row(4, "another text under an id that was used", "en"), row(None, "no id at all", None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
