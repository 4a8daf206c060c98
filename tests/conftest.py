from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (str(ROOT), os.environ.get("PYTHONPATH", "")) if p)

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lectern.session import local_session

    base = tmp_path_factory.mktemp("spark")
    s = local_session(4, "4g", **{"spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": str(base / "warehouse"), "spark.checkpoint.dir": str(base / "shared"), "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def canon():
    """A small canon. Common names and short forms of a few books, and how many verses their chapters have."""
    from lectern.canon import Canon

    def row(id_, book, abbreviation, osis, usfm, *aliases, ambiguous=()):
        return {"id": id_, "book": book, "abbreviation": abbreviation, "osis": osis, "usfm": usfm, "abbreviations": list(aliases), "ambiguous": list(ambiguous)}

    books = [
        row(9, "1 Samuel", "1 Sam", "1Sam", "1SA", "I Sam"), row(19, "Psalm", "Ps", "Ps", "PSA", "Psalms", "Psal"), row(22, "Song of Solomon", "Song", "Song", "SNG", "Song of Songs"),
        row(23, "Isaiah", "Isa", "Isa", "ISA", "is", ambiguous=["is"]), row(30, "Amos", "Am", "Amos", "AMO", ambiguous=["am"]), row(40, "Matthew", "Matt", "Matt", "MAT", "Matth"),
        row(41, "Mark", "Mk", "Mark", "MRK", "mar", ambiguous=["mar"]), row(43, "John", "Jn", "John", "JHN"), row(45, "Romans", "Rom", "Rom", "ROM"), row(46, "1 Corinthians", "1 Cor", "1Cor", "1CO"),
        row(49, "Ephesians", "Eph", "Eph", "EPH"), row(54, "1 Timothy", "1 Tim", "1Tim", "1TI"), row(62, "1 John", "1 Jn", "1John", "1JN"), row(64, "3 John", "3 Jn", "3John", "3JN"), row(65, "Jude", "Jude", "Jude", "JUD"),
    ]
    genres = [
        {"title": "Gospels", "abbreviations": ["gos"], "books": ["Matthew", "Mark", "John"], "subcategories": None},
        {"title": "Letters", "abbreviations": [], "books": ["Romans", "Ephesians", "Nowhere"], "subcategories": None},
        {"title": "New", "abbreviations": [], "books": None, "subcategories": ["gos", "Letters"]},
    ]
    counts = {
        "Matthew": [25, 23, 17, 25, 48, 34, 29, 34, 38, 42, 30, 50, 58, 36, 39, 28, 27, 35, 30, 34, 46, 46, 39, 51, 46, 75, 66, 20],
        "Mark": [45, 28, 35, 41, 43, 56, 37, 38, 50, 52, 33, 44, 37, 72, 47, 20],
        "John": [51, 25, 36, 54, 47, 71, 53, 59, 41, 42, 57, 50, 38, 31, 27, 33, 26, 40, 42, 31, 25],
        "Romans": [32, 29, 31, 25, 21, 23, 25, 39, 33, 21, 36, 21, 14, 23, 33, 27],
        "Ephesians": [23, 22, 21, 32, 33, 24], "1 Timothy": [20, 15, 16, 16, 25, 21], "3 John": [14], "Jude": [25],
    }
    return Canon.build(books, genres, counts)


@pytest.fixture(scope="session")
def finder(canon):
    from lectern.functions.refs import Finder

    return Finder(canon)
