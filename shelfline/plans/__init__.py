"""Multi-step plans: tree closure, trimming, linking, restore planning."""
