"""Page images as arrays: what is done to them before a recognizer reads them, and how its words become a record."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: Contrast around the mean; the window of the median; window and offset of the adaptive threshold.
CONTRAST, MEDIAN, BLOCK, OFFSET = 2.0, 3, 11, 2


def decoded_pnm(content: bytes) -> np.ndarray:
    """A binary PGM or PPM file as rows of grey values or of colours; other formats need a decoder of their own."""
    m = re.match(rb"(P[56])\s+(?:#.*\n)*(\d+)\s+(\d+)\s+(\d+)\s", content)
    if not m or int(m[4]) > 255:
        raise ValueError("not a binary PGM or PPM image of one byte a value")
    width, height, depth = int(m[2]), int(m[3]), 3 if m[1] == b"P6" else 1
    pixels = np.frombuffer(content, np.uint8, width * height * depth, m.end())
    return pixels.reshape(height, width, 3) if depth == 3 else pixels.reshape(height, width)


def _windows(image: np.ndarray, size: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.pad(image, size // 2, mode="edge"), (size, size))


def prepared(image: np.ndarray) -> np.ndarray:
    """Grey, with doubled contrast, without specks, black or white by the mean of each pixel's neighbourhood."""
    grey = image @ np.array([0.299, 0.587, 0.114]) if image.ndim == 3 else image.astype(np.float64)
    grey = np.clip(grey.mean() + CONTRAST * (grey - grey.mean()), 0, 255)
    grey = np.median(_windows(grey, MEDIAN), axis=(2, 3))
    return np.where(grey > _windows(grey, BLOCK).mean(axis=(2, 3)) - OFFSET, 255, 0).astype(np.uint8)


def image_extractor(recognize: Callable[[np.ndarray], list[tuple[str, float]]], decode: Callable[[bytes], np.ndarray] = decoded_pnm) -> Callable[[bytes], dict]:
    """An extractor of images from a recognizer, which gives words with confidences from 0 to 100.

    Words with a confidence above 0 count; the record's confidence is their mean, as a part of one.
    """

    def extract(content: bytes) -> dict:
        words = [(w, c) for w, c in recognize(prepared(decode(content))) if c > 0]
        mean = sum(c for _, c in words) / len(words) / 100 if words else 0.0
        return {"text": " ".join(w for w, _ in words), "extraction_method": "image", "confidence": mean, "pages_processed": 1, "ocr_pages": 1}

    return extract


def paged_extractor(pages: Callable[[bytes], list[tuple[str, bytes]]], recognize: Callable[[bytes], dict]) -> Callable[[bytes], dict]:
    """An extractor of paged files: each page's text layer, or where it is blank the recognizer on the page's image.

    Pages are joined by blank lines; the confidence is the least of the recognized pages', or 1.
    """

    def extract(content: bytes) -> dict:
        texts, least, n, recognized = [], 1.0, 0, 0
        for text, image in pages(content):
            n += 1
            if not text.strip():
                found = recognize(image)
                text, least, recognized = found["text"], min(least, found["confidence"]), recognized + 1
            texts.append(text)
        method = "text" if not recognized else "image" if recognized == n else "text and image"
        return {"text": "\n\n".join(t for t in texts if t.strip()), "extraction_method": method, "confidence": least, "pages_processed": n, "ocr_pages": recognized}

    return extract
