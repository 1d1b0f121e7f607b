"""Job building: configuration, spiders, plugins, language-model fields."""
