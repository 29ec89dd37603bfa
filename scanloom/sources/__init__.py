"""Where lines come from and where frames are kept."""
