"""Constants that are part of the results, and paths from the environment."""

import os

# Fixed values of the domain.
SAMPLE_RATE, FRAME_MS = 16000, 20
PHONE_GROUPS = {
    "s": ["s", "z", "ʃ", "ʒ"],
    "r": ["ɾ", "r", "ʁ", "ʀ", "χ", "x"],
    "dt": ["t", "d", "t͡ʃ", "d͡ʒ", "t͡ɕ"],
}
VOWELS = "aeiouɐɛɔɪʊəɨɯ"
WORD_BOUNDARY = "▁"
CODA_S = ["s", "ʃ"]
CODA_R = ["ɾ", "ʁ", "ʀ", "ħ", "χ", "r", "h", "x"]
STOPS = ["t", "d"]
FRONT_CONTEXT = ["i", "ɪ", "ʃ", "ʒ", "j"]
CANONICAL_VOWELS = ["a", "ɛ", "e", "i", "ɔ", "o", "u"]
VOWEL_SOURCES = {"a": "aɐɑɒʌə", "ɛ": "ɛæ", "e": "e", "i": "iɪɨɯ", "ɔ": "ɔ", "o": "oøɵɤ", "u": "uʊʉ"}
SPECIAL_TOKENS = ["", "<blk>", "<sos/eos>", "<unk>"]
POOL_HALF_WINDOW = 2
CAP_SECONDS, MIN_SAMPLES = 12, 512
LOGIT_SECONDS, LOGIT_LEAST_SECONDS, EMBED_HOP = 25, 0.1, 320
FFT_SIZE, BAND_HZ, LOW_BAND_HZ, HIGH_BAND_HZ = 4096, (500, 8000), (2000, 4000), (5000, 8000)
MERGE_GAP_S, MIN_SEGMENT_S = 0.3, 2.0

BASE_DIR = os.environ.get("VOZMARK_BASE", ".")
ANNOTATIONS_DB = os.environ.get("VOZMARK_ANNOTATIONS_DB", os.path.join(BASE_DIR, "annotations.db"))
