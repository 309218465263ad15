"""Kinds of documents of the sf0.1 tables, proposed by the rules and checked by reading; data for a test, no code."""

# The sample: the documents of which between a fifth and 85 in a hundred of the lines were of one kind by the rules, a random
# choice of the others of each kind, and all lists and junk of rarer makes. Three or four lines of each were read with the
# rules' kind in view. Reading found nothing against that kind but in the three blank documents, so these labels are not
# independent of the rules: they show that no mistake was seen, and guard against later changes.
LABELLED = {
    "prose": (
        96, 640, 706, 1055, 1163, 1374, 1776, 1879, 2099, 2124, 2144, 2202, 2520, 2545, 2631, 3273, 3278, 3443, 3611, 3623, 3769, 4147, 4248, 4420,
        4472, 4618, 4785, 4950, 5191, 5430, 5521, 5767, 6083, 6209, 6220, 6248, 6277, 6335, 6494, 6822, 6919, 7182, 7349, 7512, 7535, 7550, 7664,
        7762, 7806, 8073, 8113, 8132, 8334, 8346, 8545, 8997, 9003, 9186, 9375, 9610,
    ),
    "list": (
        15, 29, 292, 319, 351, 455, 512, 559, 666, 1053, 1395, 1429, 1481, 1497, 1539, 1630, 1767, 1874, 2479, 2480, 2704, 2791, 2864, 3022, 3102,
        3375, 3459, 3600, 3604, 3947, 3994, 4418, 4999, 5042, 5066, 5204, 5511, 5720, 5831, 6097, 6510, 6585, 6673, 6768, 6833, 6864, 7102, 7277,
        7290, 7573, 7750, 7883, 8086, 8253, 8348, 8607, 8737, 9193, 9269, 9448, 9633, 9719, 9741,
    ),
    "table": (
        103, 108, 285, 758, 990, 1256, 2134, 2641, 2822, 2933, 3136, 3244, 3468, 4023, 4103, 5249, 7489, 7769, 8554, 8910, 9132, 9962,
    ),
    "junk": (
        205, 227, 355, 477, 609, 760, 806, 920, 1028, 1051, 1178, 1203, 1236, 1255, 1264, 1313, 1335, 1367, 1385, 1409, 1428, 1470, 1571, 1579, 1608,
        1722, 1915, 1990, 2002, 2313, 2430, 2583, 2612, 2748, 2899, 2949, 2962, 2969, 2996, 3001, 3069, 3190, 3198, 3267, 3276, 3280, 3343, 3345,
        3378, 3384, 3425, 3474, 3482, 3751, 3763, 3900, 3911, 3945, 4039, 4041, 4152, 4201, 4262, 4342, 4377, 4397, 4452, 4493, 4516, 4541, 4887,
        4921, 4954, 4959, 4974, 4986, 5092, 5180, 5236, 5301, 5323, 5357, 5365, 5390, 5401, 5434, 5520, 5563, 5742, 5812, 5827, 5914, 5920, 5981,
        6149, 6157, 6185, 6265, 6300, 6336, 6358, 6369, 6599, 6746, 6916, 6920, 6950, 6996, 7081, 7132, 7152, 7157, 7160, 7468, 7477, 7500, 7505,
        7517, 7597, 7632, 7649, 7740, 7803, 7860, 8022, 8035, 8056, 8120, 8144, 8188, 8268, 8332, 8375, 8413, 8430, 8697, 8703, 8720, 8794, 9121,
        9187, 9354, 9376, 9383, 9488, 9496, 9534, 9611, 9671, 9691, 9864,
    ),
    "blank": (2886, 6166, 8611),
}
