"""DataFrame operators over scenes: objects, frames, runs, tweens."""
