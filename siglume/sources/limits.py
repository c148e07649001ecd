"""What all readers of audio share: their error and the bound on samples."""

MAX_SAMPLES = 1_000_000_000


class AudioError(ValueError):
    pass
