"""Region descent: routing, renders that earn their place, tiles, budgets and cycles, and renders made again."""

import numpy as np
import pytest

from textloom.functions import images
from textloom.operators import descent as D

LETTER = (8.5, 11.0, 200)
SHEET = (36.0, 27.5, 200)


def page(seed=1, high=220, wide=170):
    return np.random.default_rng(seed).integers(0, 256, (high, wide)).astype(np.uint8)


class Model:
    """Answers by depth, and keeps what it was asked."""

    def __init__(self, *answers, text=None):
        self.answers, self.asked, self.text = answers, [], text

    def __call__(self, view, depth, damage):
        self.asked.append((view.shape, depth, tuple(damage)))
        told = dict(self.answers[min(len(self.asked), len(self.answers)) - 1])
        if self.text:
            told["text"] = self.text(view, depth)
        return told


def read(ask, size=LETTER, image=None, **limits):
    return D.Reader(page() if image is None else image, ask, *size, D.Limits(**limits)).read(1)


def boxes(*found):
    return {"text": "t", "regions": [dict(zip("xywh", b)) for b in found]}


def test_coarse_sheets_are_flagged_and_letters_are_not():
    model = Model({"text": ""})
    assert "low-resolution" in read(model, SHEET)[0]["flags"] and "low-resolution" not in read(Model({"text": ""}))[0]["flags"]
    root = read(model, SHEET)[0]
    assert 3.5 < root["tokens_per_sq_in"] < 4.5
    near = read(Model(boxes((0, 0, 0.2, 0.2)), {"text": "x"}), SHEET)[1]
    assert near["tokens_per_sq_in"] > 5 * root["tokens_per_sq_in"] and near["depth"] == 1


def test_routing():
    reader = D.Reader(page(), None, *LETTER, D.Limits(children=3))
    root = reader._region((0.0, 0.0, 1.0, 1.0))
    closer, again = reader.routed(root, [
        {"x": 0, "y": 0, "w": 1, "h": 0.95}, {"x": 0, "y": 0, "w": 1, "h": 1, "rotation": 90}, {"x": 0, "y": 0, "w": 1, "h": 1, "filter": "denoise"},
        {"x": 0, "y": 0, "w": 1, "h": 1, "filter": "contrast"}, {"x": 0.2, "y": 0.2, "w": 0.05, "h": 0.05}, {"x": 0.1, "y": 0.1, "w": 0.4, "h": 0.4, "kind": "table"},
        {"x": 0.11, "y": 0.1, "w": 0.4, "h": 0.4}, {"x": 0.9, "y": 0.5, "w": 0.3, "h": 0.3}, {"x": 0.5, "y": 2, "w": 0.1, "h": 0.1}, {"x": 0, "y": 0.6, "w": 0.3, "h": 0.3}, {"x": 0.6, "y": 0, "w": 0.3, "h": 0.3},
    ])
    assert again == [(90, ""), (0, "contrast")] and [k for _, _, k in closer] == ["table", "", ""]
    x, y, w, h = closer[0][0]
    assert (x, y) == pytest.approx((0.1 - 0.15 / 8.5, 0.1 - 0.15 / 11)) and (w, h) == pytest.approx((0.4 + 0.3 / 8.5, 0.4 + 0.3 / 11))
    assert closer[1][0][0] + closer[1][0][2] == pytest.approx(1.0)
    child = reader._region((0.5, 0.5, 0.5, 0.5))
    lifted = reader.routed(child, [{"x": 0.5, "y": 0, "w": 0.4, "h": 0.5}])[0][0][0]
    assert lifted[0] == pytest.approx(0.75 - 0.15 / 8.5) and lifted[1] == pytest.approx(0.5 - 0.15 / 11)


def test_budgets_and_depth():
    many = boxes(*((i / 4, j / 3, 0.25, 0.33) for i in range(4) for j in range(3)))
    found = read(Model(many), depth=9, calls=7, inches=0.01)
    assert len([r for r in found if r["text"]]) == 7 and any("budget" in r["flags"] for r in found)
    assert len(read(Model(many), depth=1, calls=40)) == 1 + 8 and all("budget" in r["flags"] for r in read(Model(many), depth=1)[1:])
    alone = read(Model(many), depth=0)
    assert len(alone) == 1 and alone[0]["flags"][-1] == "budget"
    assert read(Model({"text": "x"}))[0]["flags"][-1] == "exhausted"
    ids = [r["region"] for r in read(Model(boxes((0.5, 0, 0.4, 0.4), (0, 0, 0.4, 0.4)), {"text": "c"}))]
    assert ids == ["p1", "p1.0", "p1.1"]


def test_a_view_that_was_seen_is_a_cycle():
    flat = np.full((220, 170), 200, np.uint8)
    whole = {"text": "a", "regions": [{"x": 0, "y": 0, "w": 1, "h": 1, "rotation": 180}]}
    model = Model(whole)
    found = read(model, image=flat)
    assert "cycled" in found[0]["flags"] and len(model.asked) == 1  # turned by half it is the same picture
    same = read(Model(boxes((0, 0, 1, 0.99))))
    assert len(same) == 1 and "exhausted" in same[0]["flags"]


def test_renders_must_earn_their_place():
    turn = {"x": 0, "y": 0, "w": 1, "h": 1, "rotation": 90}
    good = "\n".join(f"line number {i} of the deed" for i in range(8))
    loop = "\n".join(["the same line again and again"] * 60)
    won = read(Model({"text": loop, "regions": [turn]}, {"text": good}))[0]
    assert won["text"] == good and won["rotation"] == 90 and "cycled" not in won["flags"]
    assert won["sha256"] == D.digest(D.rendered(page(), (0, 0, 1, 1), 90, ""))
    lost = read(Model({"text": good, "regions": [turn]}, {"text": loop}))[0]
    assert lost["text"] == good and lost["rotation"] == 0 and "cycled" in lost["flags"]
    case = lambda a, b, expected="", flags=([], []): D.earned({"text": a, "flags": flags[0]}, {"text": b, "flags": flags[1]}, expected)
    assert case(good, good + "\nand one more line") and not case(good, good) and not case(good + "\nand one more line", good)
    assert case("zzzz zzzz zzzz", "lot seven", "lot seven of the plat") and not case("lot seven", "zzzz zzzz zzzz " * 9, "lot seven of the plat")
    assert case(good, good, flags=(["repetition"], [])) and not case(good, good, flags=(["exhausted", "budget"], []))
    told = [{"text": "a first line", "regions": [turn]}, {"text": "a first line\na second line", "regions": [{**turn, "rotation": 180}]}, {"text": "a first line\na second line\na third line"}]
    chain = read(Model(*told), depth=3)[0]
    assert chain["text"].endswith("third line") and chain["rotation"] == 180
    told[2]["regions"] = [{**turn, "rotation": 270}]  # a third render is one too many: what asks for it is a cycle, and is not taken
    assert read(Model(*told), depth=3)[0]["text"] == "a first line" and "cycled" in read(Model(*told), depth=3)[0]["flags"]


def test_a_reading_of_something_else_is_suspect():
    root = {"text": "legal description of lot seven in block four", "regions": [{"x": 0, "y": 0, "w": 0.5, "h": 0.5}]}
    assert "transform-suspect" in read(Model(root, {"text": "qqqq wwww rrrr"}))[1]["flags"]
    assert "transform-suspect" not in read(Model(root, {"text": "legal description of lot seven, thence north"}))[1]["flags"]


def test_drawings_are_tiled():
    drawing = {"text": "a plan", "kind": "drawing", "regions": [{"x": 0, "y": 0.9, "w": 0.5, "h": 0.1}]}
    found = read(Model(drawing, {"text": "tile"}), SHEET, tile=True, image=page(2, 275, 360))
    tiles = [r for r in found[1:] if r["kind"] == "drawing"]
    n = int(np.ceil(np.sqrt(39 / found[0]["tokens_per_sq_in"])))
    assert len(tiles) == n * n > 8
    covered = np.zeros((100, 100), bool)
    for t in tiles:
        covered[int(t["y"] * 100) : int(np.ceil((t["y"] + t["h"]) * 100)), int(t["x"] * 100) : int(np.ceil((t["x"] + t["w"]) * 100))] = True
    assert covered.all()
    assert len(read(Model(drawing, {"text": "t"}), SHEET, image=page(2, 275, 360))) == 2
    assert len(read(Model(drawing, {"text": "t"}), LETTER, tile=True)) == 2  # nothing coarse about a letter page


def ask(view, depth, damage):
    return {"text": f"{view.shape} at {depth}", "regions": [{"x": 0, "y": 0, "w": 0.5, "h": 0.5}, {"x": 0.5, "y": 0.4, "w": 0.5, "h": 0.5, "rotation": 90}] if depth == 0 else []}


def test_tables_of_pages(spark):
    pages = [(f"d{k}", k + 1, bytearray(page(k).tobytes()), 170, 220, 8.5, 11.0, 200) for k in range(3)] + [("none", 1, None, 0, 0, 8.5, 11.0, 200)]
    schema = "path string, page int, image binary, wide int, high int, wide_in double, high_in double, dpi int"
    df = spark.createDataFrame(pages, schema)
    found = D.read_regions(df, ask)
    rows = found.collect()
    assert len(rows) == 9 and {r["region"] for r in rows if r["path"] == "d1"} == {"p2", "p2.0", "p2.1"}
    assert all(r["holds"] for r in D.verified(found, df).collect())
    other = [(p, n, bytearray(images.rotated(np.frombuffer(bytes(i), np.uint8).reshape(220, 170), 180).tobytes()), *rest) if p == "d1" else (p, n, i, *rest) for p, n, i, *rest in pages if p != "d2"]
    holds = {(r["path"], r["region"]): r["holds"] for r in D.verified(found, spark.createDataFrame(other, schema)).collect()}
    assert all(v == (p == "d0") for (p, _), v in holds.items()) and len(holds) == 9
    assert D.read_regions(df.limit(0), ask).collect() == []
