"""A tree of files: written, walked and read, against a walk by hand."""

import os
import random

from lodestone.shared import new_folder
from lodestone.sources import tree


def by_hand(top, skipped, endings, at=""):
    out = []
    for name in sorted(os.listdir(os.path.join(top, at)), key=lambda x: x.encode("utf-16-be")):
        path = f"{at}/{name}" if at else name
        if name in skipped:
            continue
        if os.path.isdir(os.path.join(top, path)):
            out += by_hand(top, skipped, endings, path)
        elif os.path.splitext(name)[1].lower() in endings:
            out.append(path)
    return out


def test_walk_and_read_as_by_hand(spark):
    rng = random.Random(4)
    folders = ["", "src", "src/a", "src/a.ts", "node_modules", "node_modules/src", "tests", ".hidden", "_x", "Ä", "￮", "𐐀", ".git/x", "deep/er/and/deeper"]
    names = ["f.ts", "g.TSX", "h.txt", "tests", "i", ".eslintrc.js", ".md", "j.d.ts", "dist", "k.rs ", "é.py"]
    files = {}
    for _ in range(120):
        folder, name = rng.choice(folders), rng.choice(names)
        files[f"{folder}/{rng.randrange(3)}{name}" if folder else f"{rng.randrange(3)}{name}"] = rng.choice(["text\nof é", "", None])
    files |= {"src/tests": "a file of a skipped name", "top/dist.ts": "x", ".md": "no ending"}
    root = new_folder(spark, "tree")
    frame = spark.createDataFrame(list(files.items()), "path string, text string")
    tree.write(frame, root)
    tree.write(frame, root)  # a repeated task
    top = root.removeprefix("file://")
    found = tree.walk(spark, root).orderBy("place").collect()
    assert [r["path"] for r in found] == by_hand(top, tree.SKIPPED, tree.EXTENSIONS)
    assert [r["place"] for r in found] == list(range(1, len(found) + 1))
    assert all(r["size"] == len((files[r["path"]] or "").encode()) and r["modified"] for r in found)
    texts = {r["path"]: r["text"] for r in tree.read(tree.walk(spark, root).select("path"), root).collect()}
    assert texts == {r["path"]: files[r["path"]] or "" for r in found}
    fewer = tree.walk(spark, root, skipped=tree.SKIPPED | {"src"}, extensions=frozenset([".txt"])).collect()
    assert sorted(r["path"] for r in fewer) == sorted(by_hand(top, tree.SKIPPED | {"src"}, {".txt"}))


def test_empty_tree(spark, tmp_path):
    assert tree.walk(spark, str(tmp_path)).count() == 0
