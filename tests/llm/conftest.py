import pytest
from pyspark.sql import Row

WORDS = ("alder birch cedar dogwood elm fir gum hazel ironwood juniper katsura larch maple nutmeg oak pine quince "
         "rowan spruce teak ulmo vine willow yew zelkova").split()


def prose(seed: int, n: int) -> str:
    """n words in an order that depends on the seed."""
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.choice("abcdefgh")) for _ in range(n))


#: nulls, empty and very long texts, ties and repeated rows
EDGES = [
    (1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, "one", "en"), (5, "one", None), (5, "one", None),
    (6, "x" * 70_000, "de"), (7, prose(1, 30_000), "en"), (8, prose(2, 300), "en"), (9, prose(2, 300), "en"),
    (10, prose(2, 300).replace("maple", "Maple"), "fr"), (11, "été 中文 \x1c  \U0001f600.", "fr"),
    (12, "\n".join(["line one 17", "line one 18", prose(3, 60)]), "es"), (None, "no id", "en"), (13, "!!! ... 123", "es"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Documents of all odd kinds with further columns whose names the operators use inside."""
    clash = dict(score=1.0, key="k", hash=5, a=1, b=2, rep=3, slot=4, ids="z", version=7, line="l", leaf="m", n=9,
                 component_id=0, block=1, _gone="g", label=1, bucket=2, start=1, end=2, source_id=3, template="t")
    rows = [Row(doc_id=i, text=t, lang=x, source="s", n_chars=len(t or ""), **clash) for i, t, x in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                 + ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if k == 'score' else 'int'}"
                                             for k, v in clash.items())).repartition(3)


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.where("false")
