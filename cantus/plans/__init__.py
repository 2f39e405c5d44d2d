"""Views that give the engine's tables their music-structure shape."""
