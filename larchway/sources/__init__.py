"""Engine-level code: the ref catalog and its storage contract."""
