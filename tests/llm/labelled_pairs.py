"""Defects of the records at scale 0.01, read and labelled by hand; all other records there are sound."""

LABELS = {
    "empty": [23, 56, 79, 133, 145, 166, 187, 287, 344, 346, 424, 449, 486, 563, 577],
    "truncated": [19, 28, 81, 106, 139, 163, 174, 180, 191, 206, 268, 271, 275, 276, 326, 387, 459, 485, 514, 519, 549, 551],
    "refusal": [10, 17, 30, 33, 60, 90, 179, 197, 204, 216, 226, 381, 404, 409, 414, 429, 464, 494, 505, 561, 565, 585],
    "copy": [50, 64, 132, 150, 203, 320, 402, 508, 581],
    "language": [153, 312, 348, 352, 372, 516, 562],
}
