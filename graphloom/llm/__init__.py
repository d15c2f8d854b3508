"""Training-data operators: quality, sharding, media, chat, tokens, archives, licences, duplicates, secrets, packing."""
