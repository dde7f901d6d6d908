"""How well excursions found after a meal cover the true intervals."""

from sugartrace.operators import labels


def test_placement_counts_what_was_not_found(table):
    pairs = [
        (1, "late", 10, 20, 10, 20),  # the same
        (1, "late", 10, 20, 15, 25),  # a third
        (1, "late", None, None, 15, 25),
        (2, "late", 0, 10, 50, 60),  # apart
        (2, "missed", None, None, 5, 9),
    ]
    schema = "patient_id int, class string, start long, end long, true_start long, true_end long"
    rows = {r["class"]: r for r in labels.placement_quality(table(pairs, schema)).collect()}
    late, missed = rows["late"], rows["missed"]
    assert (late.runs, late.found, late.recall) == (4, 3, 0.75)
    assert abs(late.median_iou - (0 + 1 / 3) / 2) < 1e-12 and abs(late.median_iou_found - 1 / 3) < 1e-12
    assert abs(late.mean_iou - (1 + 1 / 3) / 4) < 1e-12
    assert (missed.runs, missed.found, missed.recall, missed.median_iou, missed.median_iou_found) == (1, 0, 0.0, 0.0, None)
