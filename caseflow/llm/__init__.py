"""Operators for training data: packing, removal of copies, language, mixing, personal data, quality, scores."""
