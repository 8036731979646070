"""A small shop in Python, before and after a change; data for queries about code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MODELS = '''class Base:
    def save(self):
        return store(self)


class Item(Base):
    def __init__(self, title, price=0):
        self.title = title
        self.price = price

    def label(self):
        return shorten(self.title, 12)


def shorten(text, limit):
    return text[:limit]


def store(thing):
    return thing
'''

STOCK = '''from models import Item, shorten


class Shelf:
    def __init__(self):
        self.first = Item("none")

    def add(self, title: str):
        item = Item(title, 3)
        item.label()
        return item.save()

    def describe(self):
        self.add("again")
        return self.first.label()


def open_shelf() -> Shelf:
    return Shelf()
'''

SHOP = '''import stock
from stock import open_shelf, Shelf


def run(*names):
    shelf = open_shelf()
    for name in names:
        shelf.add(name)
    return report(shelf)


def report(shelf: Shelf):
    """shorten() is named in this text only."""
    return shelf.describe()


def test_report():
    assert report(stock.open_shelf())
'''

BEFORE = {"shop/models.py": MODELS, "shop/stock.py": STOCK, "shop/shop.py": SHOP}
#: ``shorten`` takes one more argument, ``store`` is gone, ``report`` was renamed.
AFTER = {
    "shop/models.py": MODELS.replace("def shorten(text, limit):\n    return text[:limit]", "def shorten(text, limit, mark):\n    return text[:limit] + mark").replace("\n\ndef store(thing):\n    return thing\n", ""),
    "shop/stock.py": STOCK,
    "shop/shop.py": SHOP.replace("def report(", "def summary(").replace("return report(shelf)", "return summary(shelf)").replace("assert report(", "assert summary("),
}

#: Names (from, to) that have to be found, and some that mustn't.
EXPECTED = [
    ("save", "store"), ("label", "shorten"), ("add", "Item"), ("add", "label"), ("add", "save"), ("describe", "add"), ("describe", "label"), ("open_shelf", "Shelf"), ("run", "open_shelf"),
    ("run", "add"), ("run", "report"), ("report", "Shelf"), ("report", "describe"), ("test_report", "report"), ("test_report", "open_shelf"), ("Item", "Base"),
]
FORBIDDEN = [("report", "shorten"), ("store", "save"), ("run", "describe"), ("shorten", "label")]


def files(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(texts.items()), "path string, content string")


def changes(spark: SparkSession) -> DataFrame:
    from ..model import FILE_CHANGE

    return spark.createDataFrame([(p, "modified", None, BEFORE[p], AFTER[p]) for p in BEFORE], FILE_CHANGE)
