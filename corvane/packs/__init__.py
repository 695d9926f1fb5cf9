"""Language packs: what declares names in files of one language."""
