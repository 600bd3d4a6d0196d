"""Operations for preparing training text at scale; nothing else in waynet imports this."""
