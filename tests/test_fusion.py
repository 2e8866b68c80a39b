"""The fused decision: cases on small tables, corroboration against brute force."""

import random

import pytest
from lotwise.operators import fusion as U

DET = "item_id string, pos long, label string, score double, image_index int, x1 double, y1 double, x2 double, y2 double, accepted string, width int"


def decide(spark, *found):
    rows = [("a", k, label, score, image, *map(float, box), "x", 1) for k, (label, score, image, box) in enumerate(d if len(d) == 4 else (*d, (10, 10, 210, 210)) for d in found)]
    return U.fused_decision(spark.createDataFrame(rows, DET)).first()


COOLER = ("tower_cpu_cooler", 0.8, 1, (100, 100, 500, 500))
CASES = {
    "two images support each other": ([("cpu_installed", 0.49, 1), ("cpu_installed", 0.48, 2)], "visible_cpu_likely", []),
    "conflict": ([("cpu_installed", 0.62, 1), ("empty_lga_socket", 0.60, 2)], "unclear", ["conflicting_socket_evidence"]),
    "damage in one image": ([("bent_socket_pins", 0.9, 1)], "unclear", ["socket_state_unclear"]),
    "damage in two images": ([("bent_socket_pins", 0.7, 1), ("bent_socket_pins", 0.7, 2)], "unclear", ["socket_state_unclear", "possible_physical_damage"]),
    "empty socket over coolers": ([("empty_lga_socket", 0.72, 1), ("tower_cpu_cooler", 0.44, 2), ("tower_cpu_cooler", 0.43, 3)], "empty_socket_likely", ["uncorroborated_cooler_detections_rejected"]),
    "three cues": ([("exposed_lga_contact_field", 0.48, 1), ("lga_center_rectangle", 0.46, 1), ("open_lga_retention_frame", 0.43, 2)], "empty_socket_likely", []),
    "cues over coolers": ([("exposed_lga_contact_field", 0.55, 1), ("lga_center_rectangle", 0.50, 1), ("tower_cpu_cooler", 0.44, 2), ("tower_cpu_cooler", 0.43, 3)], "empty_socket_likely", ["uncorroborated_cooler_detections_rejected"]),
    "cooler alone": ([COOLER], "unclear", ["uncorroborated_cooler_detections_rejected", "socket_state_unclear"]),
    "one part": ([COOLER, ("cpu_fan_blades", 0.7, 1, (180, 180, 420, 420))], "unclear", ["uncorroborated_cooler_detections_rejected", "socket_state_unclear"]),
    "a part elsewhere": ([COOLER, ("cpu_fan_blades", 0.8, 1, (700, 700, 900, 900)), ("cpu_fan_hub", 0.8, 1, (700, 700, 900, 900))], "unclear", ["uncorroborated_cooler_detections_rejected", "socket_state_unclear"]),
    "parts of another image": ([COOLER, ("cpu_fan_blades", 0.8, 2, (160, 160, 440, 440)), ("cpu_fan_hub", 0.8, 2, (160, 160, 440, 440))], "unclear", ["uncorroborated_cooler_detections_rejected", "socket_state_unclear"]),
    "hub and blades": ([COOLER, ("cpu_fan_hub", 0.7, 1, (220, 220, 320, 320)), ("cpu_fan_blades", 0.72, 1, (160, 160, 440, 440))], "cooler_attached_cpu_highly_likely", []),
    "fins and pipes": ([COOLER, ("heatsink_fin_stack", 0.65, 1, (180, 150, 420, 480)), ("cooler_heatpipes", 0.62, 1, (200, 180, 400, 460))], "cooler_attached_cpu_highly_likely", []),
    "blades and fins": ([COOLER, ("heatsink_fin_stack", 0.65, 1, (180, 150, 420, 480)), ("cpu_fan_blades", 0.62, 1, (200, 180, 400, 460))], "cooler_attached_cpu_highly_likely", []),
    "hub and pipes aren't enough": ([COOLER, ("cpu_fan_hub", 0.65, 1, (180, 150, 420, 480)), ("cooler_heatpipes", 0.62, 1, (200, 180, 400, 460))], "unclear", ["uncorroborated_cooler_detections_rejected", "socket_state_unclear"]),
    "cover": ([("socket_cover", 0.7, 1)], "socket_cover_likely", []),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    found, state, reasons = CASES[name]
    r = decide(spark, *found)
    assert (r["cpu_state"], r["review_reasons"], r["needs_review"]) == (state, reasons, bool(reasons))
    assert r["damaged"] == ("possible_physical_damage" in reasons) and (r["accepted"] > 0) == (state == "cooler_attached_cpu_highly_likely")


def test_cues_take_the_empty_score(spark):
    r = decide(spark, *CASES["three cues"][0])
    top = 0.48 + 0.18 * (0.46 + 0.43) / 2 + 0.05 * 2 + 0.05
    assert r["maxima"]["empty_lga_visual_cues"] == r["empty_score"] == r["cpu_confidence"] == round(top, 4) and r["empty_images"] == 2


def test_points_and_rejected(spark):
    r = decide(spark, ("cpu_installed", 0.9, 1), ("ram_dimm", 0.46, 1), ("nvme_ssd", 0.45, 1), COOLER)
    assert (r["value_score"], r["rejected"], r["accepted"], r["rejected_score"]) == (80 + 35, 1, 0, 0.8)
    assert "tower_cpu_cooler" not in r["maxima"] and r["cooler_score"] == 0


@pytest.mark.parametrize("cell", [16.0, 64.0, 10_000.0])
def test_corroboration_equals_brute_force(spark, cell):
    rng = random.Random(cell)
    labels = [*U.COOLERS[:2], *U.COOLER_PARTS]
    rows = []
    for k in range(600):
        x, y = rng.uniform(-50, 200), rng.uniform(-50, 200)
        rows.append((rng.choice("ab"), k, rng.choice(labels), 0.5, rng.choice((None, 0, 1, 2, 3, 4, 5, 6)), x, y, x + rng.choice((0, 20, 60, 150)), y + rng.uniform(0, 90), "", 0))

    def shared(p, q):
        w, h = min(p[7], q[7]) - max(p[5], q[5]), min(p[8], q[8]) - max(p[6], q[6])
        small = min((r[7] - r[5]) * (r[8] - r[6]) for r in (p, q))
        return small > 0 and max(0, w) * max(0, h) / small >= 0.35

    want = {}
    for p in rows:
        if p[2] in U.COOLERS:
            parts = {q[2] for q in rows if q[2] in U.COOLER_PARTS and q[0] == p[0] and q[4] == p[4] and shared(p, q)}
            want[p[1]] = any(set(c) <= parts for c in U.COOLER_COMBINATIONS)
    found = U.corroborated(spark.createDataFrame(rows, DET).drop("accepted"), cell=cell)
    got = {r["pos"]: r["accepted"] for r in found.collect()}
    assert len(got) == 600 and {k: v for k, v in got.items() if v is not None} == want and 20 < sum(want.values()) < len(want) - 20


def test_empty_table_and_nulls(spark):
    d = spark.createDataFrame([(None, 1, "cpu_installed", 0.9, 1, 0.0, 0.0, 1.0, 1.0, "", 1), ("b", 1, None, None, None, None, None, None, None, "", 1)], DET)
    assert U.fused_decision(d.where("pos > 5")).count() == 0
    r = U.fused_decision(d).collect()
    assert [(x["item_id"], x["cpu_state"], x["cpu_confidence"]) for x in r] == [("b", "unclear", 0.0)]
