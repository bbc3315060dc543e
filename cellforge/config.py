"""Classes and correspondences that the operators take as defaults."""

from __future__ import annotations

# Class ids and names; 1 to 5 can change, 6 and 7 cannot, 0 is no data.
CLASSES = {1: "urban", 2: "cropland", 3: "grassland", 4: "forest", 5: "nonforestnatural", 6: "water", 7: "barren_and_other"}
CHANGEABLE = (1, 2, 3, 4, 5)
NODATA_FLOAT, NODATA_BYTE = -9999.0, 255

# Detailed land-cover code -> simple class.
RECLASS = {
    10: 2, 11: 2, 12: 2, 20: 2, 30: 2, 40: 2, 50: 4, 60: 4, 61: 4, 62: 4, 70: 4, 71: 4, 72: 4, 80: 4, 81: 4, 82: 4, 90: 4, 100: 4, 110: 5,
    120: 5, 121: 5, 122: 5, 130: 3, 140: 5, 150: 5, 151: 5, 152: 5, 153: 5, 160: 4, 170: 4, 180: 5, 190: 1, 200: 7, 201: 7, 202: 7, 210: 6, 220: 7,
}
#: Simple class -> the detailed code that stands for it when a map is restored.
RESTORE = {1: 190, 2: 10, 3: 130, 4: 50, 5: 120, 6: 210, 7: 200}

# Coarse state -> class.
STATES = {
    "c3ann": "cropland", "c3nfx": "cropland", "c3per": "cropland", "c4ann": "cropland", "c4per": "cropland", "pastr": "grassland", "range": "grassland",
    "primf": "forest", "secdf": "forest", "primn": "nonforestnatural", "secdn": "nonforestnatural", "urban": "urban",
}

# Half-lives of the kernels.
HALF_LIVES = (1, 2, 3, 4, 5, 7, 9, 12, 15, 30)
